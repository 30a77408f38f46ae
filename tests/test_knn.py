import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotelake import config as C
from quotelake.functions import vectors as V
from quotelake.operators import knn


def _frame(spark, n, dim, seed, name):
    rng = np.random.default_rng(seed)
    mat = rng.normal(size=(n, dim))
    mat[n // 2] = mat[0]  # an exact tie
    mat /= np.linalg.norm(mat, axis=1, keepdims=True)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(mat)]
    return mat, spark.createDataFrame(rows, f"{name} long, vec array<double>")


@pytest.mark.parametrize("sizing", [{}, {"shard_bytes": 2000}, {"shard_bytes": 2000, "broadcast_bytes": 0, "salts": 3}])
def test_topk_equals_brute_force(spark, sizing):
    q, queries = _frame(spark, 40, 8, 1, "q")
    c, corpus = _frame(spark, 90, 8, 2, "c")
    got = knn.knn_topk(queries, corpus, ["q"], "c", k=5, block=16, **sizing)
    rows = {(r["q"], r["rank"]): (r["c"], r["score"]) for r in got.collect()}
    score = np.rint(q @ c.T * 1e6) / 1e6
    for i in range(len(q)):
        order = sorted(range(len(c)), key=lambda j: (-score[i, j], j))[:5]
        assert [rows[(i, r + 1)] for r in range(5)] == [(j, score[i, j]) for j in order]
    assert len(rows) == 200


@pytest.mark.parametrize("sizing", [{}, {"shard_bytes": 4000}])
def test_late_and_early_encoding_agree(spark, sizing):
    texts = [(i, f"word{i % 7} alpha beta gamma{i % 3}") for i in range(30)]
    df = spark.createDataFrame(texts, "q long, text string")
    e = V.BowEmbedder(16)
    corpus = df.select(F.col("q").alias("c"), V.embed_column(e, F.col("text"), False).alias("vec"))
    got = knn.knn_topk(df, corpus, ["q"], "c", query_vec="text", k=3, dim=16, encode=e.encode, **sizing)
    want = (np.rint(e.encode([t for _, t in texts], True) @ e.encode([t for _, t in texts], False).T * 1e6)) / 1e6
    for r in got.collect():
        assert abs(want[r["q"], r["c"]] - r["score"]) < 1e-9
    assert got.count() == 90


def test_python_and_native_buckets_agree(spark):
    words = ["abc", "grace", "don't", "zebra", "the"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    e = V.BowEmbedder(C.EMBED_DIM)
    for r in df.select("w", V.word_bucket(F.col("w")).alias("b")).collect():
        assert e._bucket(r["w"]) == r["b"]


def test_scores_of_a_block_are_held_in_slices():
    rng = np.random.default_rng(4)
    q, c, ids = rng.normal(size=(512, 8)), rng.normal(size=(30_000, 8)), rng.permutation(30_000)
    tracemalloc.start()
    best, scores, k = knn._top(q, c, ids, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20  # all scores at once are 120 MB, and several times that with their ranks
    for i in (0, 34, 35, 511):
        ranked = np.rint(q[i] @ c.T * 1e6)
        want = np.lexsort((ids, -ranked))[:5]
        assert best.reshape(-1, k)[i].tolist() == want.tolist()
        assert np.allclose(scores.reshape(-1, k)[i], ranked[want] / 1e6)


def test_texts_are_encoded_in_slices():
    texts = [f"alpha beta{i % 9} gamma" for i in range(8000)]
    e = V.BowEmbedder(C.EMBED_DIM)
    tracemalloc.start()
    mat = V.encoded(e.encode, texts, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20  # the vectors are 25 MB; counts and squares of all would be as much again, each
    assert (mat == e.encode(texts, False)).all()
    assert V.encoded(e.encode, [], True).shape == (0, C.EMBED_DIM)


@pytest.mark.parametrize("sizing", [{}, {"shard_bytes": 400}, {"shard_bytes": 400, "held_bytes": 0}])
def test_one_worker_encodes_and_answers_texts_against_a_held_corpus(spark, sizing):
    texts = [f"word{'abcdefg'[i % 7]} alpha beta gamma{'xyz'[i % 3]}" for i in range(1200)]
    queries = spark.createDataFrame(list(enumerate(texts)) + [(1200, None)], "q long, text string").repartition(5)
    queries = queries.filter("spark_partition_id() != 2").unionByName(queries.filter("q < 0"))  # tasks without rows
    corpus = spark.createDataFrame([(3 * i, t) for i, t in enumerate(texts[:12])], "c long, text string")
    e = V.BowEmbedder(16)
    corpus = corpus.select("c", V.embed_column(e, F.col("text"), False).alias("vec"), F.col("text").alias("said"))
    got = knn.knn_lists(queries, corpus, ["q"], "c", query_vec="text", k=5, meta=["said"], dim=16, encode=e.encode, **sizing)
    workers = got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    assert workers == (2 if "held_bytes" in sizing else 1)
    rows = got.collect()
    assert sorted(r["q"] for r in rows) == sorted(r["q"] for r in queries.collect()) and len(rows) > 600
    asked = e.encode([*texts, None], True)
    score = np.rint(asked @ e.encode(texts[:12], False).T * 1e6) / 1e6
    for r in rows:
        order = sorted(range(12), key=lambda j: (-score[r["q"], j], j))[:5]
        want = [(n + 1, score[r["q"], j], 3 * j, texts[j]) for n, j in enumerate(order)]
        assert [tuple(h) for h in r["cands"]] == want


def test_texts_against_no_corpus_have_no_answer(spark):
    e = V.BowEmbedder(16)
    queries = spark.createDataFrame([(1, "alpha")], "q long, text string")
    corpus = spark.createDataFrame([], "c long, vec array<double>")
    got = knn.knn_lists(queries, corpus, ["q"], "c", query_vec="text", dim=16, encode=e.encode)
    assert got.collect() == []
