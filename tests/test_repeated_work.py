"""Texts are searched once: no filter that Spark adds for empty lists repeats the work at the scan."""

import pytest
from pyspark.sql import functions as F

from quotelake import lexicons as L
from quotelake.catalog import label_queries as LQ
from quotelake.functions import signals as S
from quotelake.functions import vectors as V
from quotelake.operators import labels as LB
from quotelake.operators import sentences as SE
from quotelake.plans import detection as D


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A frame read back from files, so that filters can be pushed to its scan."""
    def store(rows, schema):
        path = str(tmp_path_factory.mktemp("rows") / "t")
        spark.createDataFrame(rows, schema).write.parquet(path)
        return spark.read.parquet(path)

    return store


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_breaks_are_found_once(spark, stored):
    spark.conf.set("spark.sql.maxPlanStringLength", "1000000")
    files = stored(
        [(1, ["As", "we", "read", "in", "John", "today"]), (2, ["nothing"]), (3, []), (4, None)],
        "doc_id long, words array<string>",
    )
    found = LB.break_positions(files)
    for df in (LB.break_rows(found, ["doc_id"]), LB.break_rows(LB.thin_breaks(found), ["doc_id"]),
               LB.build_lines(LB.thin_breaks(found))):
        assert plan(df).count("regexp_extract_all(") == 1
    rows = {tuple(r) for r in LB.break_rows(found, ["doc_id"]).collect()}
    assert rows == {(1, 0, "as we read")}
    lines = LB.build_lines(LB.thin_breaks(found)).select("doc_id", "line_no", "text").collect()
    assert sorted(map(tuple, lines)) == [(1, 1, "As we read in John today"), (2, 1, "nothing")]


@pytest.mark.parametrize("text", ["JOHN says", "ajohn", "john", "x john, Romans; romansx", "ın the niv in the NIV", "Kings kings"])
def test_first_letter_test_changes_no_match(spark, text):
    plain = r"(?i)\b" + LB.L.either(LB.L.trigger_table()) + r"\b"
    df = spark.createDataFrame([(text,)], "t string").select(
        F.regexp_extract_all("t", F.lit(f"({plain})"), 1).alias("a"),
        F.regexp_extract_all("t", F.lit(f"({LB.TRIGGER_PATTERN})"), 1).alias("b"),
    )
    assert df.first()["a"] == df.first()["b"]


def test_words_are_found_and_hashed_once(spark, stored):
    docs = stored([(1, "The dog, the cat's an x"), (2, "a b"), (3, None), (1, "dog")], "doc_id long, text string")
    dims = V.bow_dims(docs, ["doc_id"], "text", 1 << 20)
    assert plan(dims).count("regexp_extract_all(") == 1
    want = spark.createDataFrame([(1, w) for w in ("the", "dog", "the", "cat's", "dog")], "doc_id long, w string")
    want = want.select("doc_id", V.word_bucket(F.col("w"), 1 << 20).alias("dim"))
    assert sorted(map(tuple, dims.collect())) == sorted(map(tuple, want.collect()))


def test_sentences_are_split_once(stored):
    docs = stored([(1, "One. Two!  Three"), (2, "  "), (3, None)], "doc_id long, text string")
    rows = SE.document_sentences(docs)
    assert plan(rows).count("split(") == 1
    assert sorted(map(tuple, rows.collect())) == [(1, 0, "One."), (1, 1, "Two!"), (1, 2, "Three")]


def test_signals_are_tested_once_before_the_gate(spark, stored):
    windows = stored([(1, "The Bible says love is patient", 0.0, 1.0)],
                     "sent_id long, candidate_text string, start_time double, end_time double")
    passages = spark.createDataFrame([(0, "AMP", "John", 1, 1, "love is patient")],
                                     "passage_id long, edition string, work string, section int, item int, text string")
    found = D.detect_windows(windows, passages, ["sent_id"])
    assert plan(found).count("RLIKE") == 6
    sure = found.first()["quote_probability"]
    assert sure >= 0.92
    # a column of that name in the rows does not stand in for the rule score
    stale = D.detect_windows(windows.withColumn("rule_score", F.lit(0.0)), passages, ["sent_id"])
    assert stale.first()["quote_probability"] == sure


def test_cheap_tests_change_no_signal(spark):
    phrases = [*L.CUE_PHRASES, *L.BARE_WORK_NAMES]
    said = [f"{a} {b}" for a in L.SPEAKERS for b in L.QUOTING_VERBS[:3]]
    turned = [f"{a} {b}" for a in L.INVERTED_VERBS for b in L.INVERTED_SPEAKERS]
    ways = ["1", "2", "3", "1st", "2nd", "3rd", "first", "second", "third"]
    numbered = [f"{n}{gap}{w}" for n in ways for gap in (" ", "\n", "\t ") for w in [*L.NUMBERED_12, "john"]]
    cites = ["John 3:16", "3 : 16", "3.16", "john 3:1", "a:b", "1:2", ":", ""]
    texts = [p + x for p in [*phrases, *said, *turned, *numbered, *cites] for x in ("", "s")]
    texts = [x + t for t in texts for x in ("", "so ", "x", "1")]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    low = F.lower("t")
    pairs = [
        (S.cue(F.col("t")), low.rlike(L.CUE_PATTERN)), (S.names_work(F.col("t")), low.rlike(L.WORK_NAME_PATTERN)),
        (S.attributed(F.col("t")), low.rlike(L.ATTRIBUTION_PATTERN) | low.rlike(L.INVERTED_PATTERN)),
        (S.cited(F.col("t")), F.col("t").rlike(L.NAMED_REF_PATTERN) | F.col("t").rlike(L.BARE_REF_PATTERN)),
    ]
    for now, plain in pairs:
        counts = df.agg(F.count_if(now != plain).alias("other"), F.count_if(plain).alias("hits")).first()
        assert counts["other"] == 0 and counts["hits"] > 0


def test_texts_are_joined_once_for_training(spark, tmp_path):
    docs = [(i, f"good word{i}" if i % 2 else f"bad thing{i}", "src") for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(i, i % 2, 0) for i in range(60)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = LQ.train_eval_classifier(spark, str(tmp_path))
    assert "labels.parquet" not in plan(df)
    assert sum(df.first()[c] for c in ("tp", "fp", "fn", "tn")) == 6
