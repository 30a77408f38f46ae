"""Exact cosine top-k by blocked matrix products.

The corpus is packed into shards of bounded bytes and the queries into blocks, both as Arrow
lists. A block meets a shard through an equi-join on the shard number, one numpy product scores
the pair, and only the k best per query leave the task: scores are never materialised as rows.
If the packed corpus is proven small its shards are broadcast and the queries are not shuffled;
otherwise the shards are replicated over a salt and joined by shuffle, so one shard is never the
only reducer. Query texts that meet a corpus which a task can hold are not packed: its shards enter a
task with the first query and are held once, and one Python worker does all work of the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.vectors import encoded
from ..session import short_batches

SCORE_UNIT = 1_000_000  # scores are compared at six decimals, ties by corpus id
CELLS = 1 << 20  # scores that a task holds at a time
ROWS = 512  # queries that a task encodes and answers at a time


def _field(name: str):
    return lambda row: row[name]


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _pack_queries(df: DataFrame, columns: list[str], vec: str, block: int, encode) -> DataFrame:
    """Blocks of at most `block` queries: one list per column, and `_qv` with all vectors in a row.

    With `encode` the vectors are computed from texts here.
    """
    fields = [t.StructField(c, t.ArrayType(df.schema[c].dataType)) for c in columns]
    fields.append(t.StructField("_qv", t.ArrayType(t.DoubleType())))
    schema = t.StructType(fields)
    arrow = to_arrow_schema(schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, block):
                part = whole.slice(at, block)
                cols = [_one_list(part.column(c)) for c in columns]
                body = part.column(vec)
                body = pa.array(encoded(encode, body.to_pylist(), True).ravel()) if encode else (
                    body.flatten().cast(pa.float64())
                )
                cols.append(_one_list(body))
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow
                )

    return df.select(*dict.fromkeys([*columns, vec])).mapInArrow(pack, schema)


def _with_shards(queries: DataFrame, columns: list[str], packed: DataFrame, shards: int) -> DataFrame:
    """The queries where they are; the first of every task comes once with each shard of the corpus."""
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    numbers = F.when(first, F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array(F.lit(None).cast("int")))
    rows = queries.select(*columns, F.explode_outer(numbers).alias("_shard"))
    return rows.join(F.broadcast(packed), "_shard", "left")


def _top(q: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int):
    """Positions and scores of the k best corpus rows of every query row, best first.

    The queries meet the corpus in slices of at most `CELLS` scores, so memory does not grow with either side.
    A corpus in the order of its ids is not copied.
    """
    order = np.argsort(ids, kind="stable")
    n = len(ids)
    k = min(k, n)
    c, late = (c if (ids[1:] >= ids[:-1]).all() else c[order]).T, n - 1 - np.arange(n)
    step = max(1, CELLS // n)
    found, scores = np.empty((len(q), k), "int64"), np.empty((len(q), k))
    for at in range(0, len(q), step):
        exact = q[at:at + step] @ c
        exact *= SCORE_UNIT
        ranked = np.rint(exact, out=exact).astype("int64")
        composite = ranked * n
        composite += late
        best = np.argpartition(composite, n - k, axis=1)[:, n - k:]
        values = np.take_along_axis(composite, best, axis=1)
        best = np.take_along_axis(best, np.argsort(-values, axis=1), axis=1)
        scores[at:at + step] = np.take_along_axis(ranked, best, axis=1) / SCORE_UNIT
        found[at:at + step] = order[best]
    return found.ravel(), scores.ravel(), k


def _top_of(q: np.ndarray, shards: list[tuple[np.ndarray, np.ndarray]], k: int):
    """As `_top`, over shards of vectors and ids; positions count through all of them."""
    found, scores, ids, base = [], [], [], 0
    for c, own in shards:
        best, score, width = _top(q, c, own, k)
        found.append(best.reshape(-1, width) + base)
        scores.append(score.reshape(-1, width))
        ids.append(own[best].reshape(-1, width))
        base += len(own)
    found, scores, ids = np.hstack(found), np.hstack(scores), np.hstack(ids)
    order = np.lexsort((ids, -scores))[:, :k]
    width = order.shape[1]
    return np.take_along_axis(found, order, 1).ravel(), np.take_along_axis(scores, order, 1).ravel(), width


def knn_lists(
    queries: DataFrame,
    corpus: DataFrame,
    query_keys: list[str],
    corpus_id: str,
    query_vec: str = "vec",
    corpus_vec: str = "vec",
    k: int = 10,
    carry: list[str] | None = None,
    meta: list[str] | None = None,
    block: int = 2048,
    shard_bytes: int = 32 << 20,
    broadcast_bytes: int = 256 << 20,
    held_bytes: int = 96 << 20,
    salts: int = 32,
    dim: int | None = None,
    encode=None,
    out: str = "cands",
) -> DataFrame:
    """One row per query: keys, carried columns and `out`, the exact k nearest corpus rows as
    array<struct<rank, score, corpus_id, meta...>>.

    Vectors are expected to be unit length, so the product is the cosine. A count of the corpus
    sizes the shards. With `encode` the query column holds texts; if the corpus has at most
    `held_bytes` they are encoded next to the product, so query vectors never leave the Python
    worker, queries are not shuffled at all, and a worker holds that corpus and one batch.
    """
    carry, meta = list(carry or []), list(meta or [])
    short_batches(corpus.sparkSession)
    if dim is None:
        first = corpus.select(F.size(corpus_vec).alias("d")).filter("d > 0").first()
        dim = first["d"] if first else 1
    size = corpus.count()
    total = size * (dim * 8 + 8)
    shards = max(1, -(-total // shard_bytes))

    packed = (
        corpus.select(
            F.pmod(F.xxhash64(corpus_id), F.lit(shards)).cast("int").alias("_shard"),
            F.struct(
                F.col(corpus_id).cast("long").alias(corpus_id),
                F.col(corpus_vec).cast("array<double>").alias("_v"), *meta,
            ).alias("r"),
        )
        .groupBy("_shard")
        .agg(F.array_sort(F.collect_list("r")).alias("rows"))
        .select(
            "_shard",
            F.transform("rows", lambda r: r[corpus_id]).alias("_ci"),
            F.flatten(F.transform("rows", lambda r: r["_v"])).alias("_cv"),
            *[F.transform("rows", _field(m)).alias(f"_m_{m}") for m in meta],
        )
    )
    late = encode if total <= min(held_bytes, broadcast_bytes) else None
    columns = list(dict.fromkeys([*query_keys, *carry, *([query_vec] if late else [])]))
    if late:
        pairs = _with_shards(queries, columns, packed, shards)
    else:
        blocks = _pack_queries(queries, columns, query_vec, block, encode)
        blocks = blocks.withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        if total <= broadcast_bytes:
            pairs = blocks.join(F.broadcast(packed), "_shard")
        else:
            salt = F.pmod(F.xxhash64(query_keys[0], "_shard"), F.lit(salts))
            copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
            pairs = blocks.withColumn("_salt", salt).join(
                packed.withColumn("_salt", copies), ["_shard", "_salt"]
            )

    kept = list(dict.fromkeys([*query_keys, *carry]))
    hit = t.StructType(
        [t.StructField("rank", t.IntegerType()), t.StructField("score", t.DoubleType()),
         t.StructField(corpus_id, t.LongType()), *[corpus.schema[m] for m in meta]]
    )
    schema = t.StructType(
        [*[queries.schema[c] for c in kept], t.StructField(out, t.ArrayType(hit))]
    )
    arrow = to_arrow_schema(schema)
    hit_arrow = to_arrow_schema(hit)

    shard_columns = ["_ci", "_cv", *[f"_m_{m}" for m in meta]]

    def answers(cols: list[pa.Array], q: np.ndarray, vectors: list[np.ndarray], held: list[pa.ChunkedArray]):
        ids = [chunk.to_numpy() for chunk in held[0].chunks]
        best, scores, width = _top_of(q, list(zip(vectors, ids)), k)
        taken = pa.array(best)
        parts = [
            pa.array(np.tile(np.arange(1, width + 1, dtype="int32"), len(q))), pa.array(scores),
            *[h.take(taken).combine_chunks() for h in held],
        ]
        hits = pa.StructArray.from_arrays(
            [p.cast(f.type) for p, f in zip(parts, hit_arrow)], fields=list(hit_arrow)
        )
        offsets = pa.array(np.arange(len(q) + 1, dtype="int32") * width)
        cols = [*cols, pa.ListArray.from_arrays(offsets, hits)]
        return pa.RecordBatch.from_arrays([col.cast(f.type) for col, f in zip(cols, arrow)], schema=arrow)

    def corpus_rows(rows: list[dict]) -> tuple[list[np.ndarray], list[pa.ChunkedArray]]:
        vectors = [row["_cv"].to_numpy().reshape(-1, dim) for row in rows]
        return vectors, [pa.chunked_array([row[name] for row in rows]) for name in shard_columns if name != "_cv"]

    def values(batch: pa.RecordBatch, r: int, names: list[str]) -> dict:
        return {name: batch.column(name)[r].values for name in names}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = values(batch, r, batch.schema.names)
                q = row["_qv"].to_numpy().reshape(-1, dim)
                yield answers([row[name] for name in kept], q, *corpus_rows([row]))

    def score_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, seen = [], 0
        for batch in batches:
            lead = min(shards - seen, batch.num_rows)
            found += [values(batch, r, shard_columns) for r in range(lead)]
            seen += lead
            if seen < shards or not size:
                continue
            if lead:
                found = [row for row in found if row["_ci"] is not None]
                if sum(len(row["_ci"]) for row in found) != size:
                    raise ValueError("the first query of a task came without the whole corpus")
                corpus_held = corpus_rows(found)
                batch = batch.slice(lead - 1)
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                q = late(part.column(query_vec).to_pylist(), True)
                yield answers([part.column(name) for name in kept], q, *corpus_held)

    local = pairs.select(
        *columns, *([] if late else ["_qv"]), *shard_columns
    ).mapInArrow(score_texts if late else score, schema)
    if late or shards == 1:
        return local
    # at most shards * k rows per query meet here
    merged = local.groupBy(*query_keys).agg(
        *[F.first(c).alias(c) for c in kept if c not in query_keys],
        F.array_sort(
            F.flatten(
                F.collect_list(
                    F.transform(
                        out, lambda h: F.struct((-h["score"]).alias("o"), h[corpus_id].alias("i"), h.alias("h"))
                    )
                )
            )
        ).alias(out),
    )

    def ranked(x, i):
        fields = [x["h"][f].alias(f) for f in ("score", corpus_id, *meta)]
        return F.struct((i + 1).cast("int").alias("rank"), *fields)

    return merged.withColumn(out, F.transform(F.slice(out, 1, k), ranked))


def knn_topk(
    queries: DataFrame, corpus: DataFrame, query_keys: list[str], corpus_id: str, **kw
) -> DataFrame:
    """Query keys, `rank`, `score`, `corpus_id` of the exact k nearest corpus vectors, as rows."""
    lists = knn_lists(queries, corpus, query_keys, corpus_id, **kw)
    return lists.select(*query_keys, F.inline("cands"))


def filter_edition(hits: DataFrame, query_keys: list[str], edition: str, k: int) -> DataFrame:
    """Keep one edition of an over-fetched result and re-rank to k (may return fewer)."""
    kept = hits.filter(F.col("edition") == edition)
    w = Window.partitionBy(*query_keys).orderBy("rank")
    return kept.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
