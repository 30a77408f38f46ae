"""MinHash near-duplicates with tensored banding.

Two collections of ``groups`` half keys are computed, each half key from two minhashes. A table key is
a pair of one half key from each collection, so 4 * groups minhashes serve groups ** 2 tables. Two
documents of similarity s meet in a table with probability (1 - (1 - s**2) ** groups) ** 2: 0.9995 at
0.75 for ten groups. Candidates are confirmed on the full shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelake.llm.common import bounded_broadcast, byte_view, lists, mixed, saved, steps, tidied
from quotelake.llm.components import NEAR_ROWS, components
from quotelake.llm.words import shingle_sets

WIDTH, SIMILARITY, GROUPS = 5, 75, 10
BLOCK_ROWS, BLOCK_SHINGLES, SLICE = 128, 1 << 16, 4096
STEP = 1 << 18  # bytes of text looked at together; a dozen arrays of eight bytes each go with them
CLASS = ["h1", "h2", "n_shingles"]
SIGNATURE = "id long, k long, n_shingles long, h1 long, h2 long, half array<long>"


def _constants(groups: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(7))
    flips = rng.integers(0, 2**64 - 1, 4 * groups, dtype=np.uint64)
    return flips, rng.integers(0, 2**64 - 1, 4 * groups, dtype=np.uint64) | np.uint64(1)


def _digests(sets: np.ndarray, sizes: np.ndarray, flip: np.uint64) -> np.ndarray:
    """Two sums over each set; zeros for an empty one."""
    full = np.flatnonzero(sizes)
    digest = np.zeros((2, len(sizes)), np.uint64)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        digest[0, full] = np.add.reduceat(mixed(sets), starts)
        digest[1, full] = np.add.reduceat(mixed(sets ^ flip), starts)
    return digest


def signatures(docs: DataFrame, width: int, groups: int) -> DataFrame:
    """Per row: size of the shingle set, a 128-bit digest of it and the 2 * groups half keys."""
    flips, factors = _constants(groups)

    def run(batches):
        for batch in batches:
            for part in steps(batch, "text", STEP):
                sets, sizes = shingle_sets(*byte_view(part.column("text")), width)
                full = np.flatnonzero(sizes)
                starts = (np.cumsum(sizes) - sizes)[full]
                digest = _digests(sets, sizes, flips[0])
                half = np.zeros((len(full), 2 * groups), np.uint64)
                if len(full):
                    for k in range(4 * groups):
                        low = np.minimum.reduceat((sets ^ flips[k]) * factors[k], starts)
                        half[:, k // 2] = half[:, k // 2] * factors[0] + low
                lengths = np.where(sizes > 0, 2 * groups, 0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("k"), pa.array(sizes.astype(np.int64)),
                     pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)),
                     lists(mixed(half).view(np.int64).ravel(), lengths, pa.int64())],
                    ["id", "k", "n_shingles", "h1", "h2", "half"],
                )

    return docs.select("id", "k", "text").mapInArrow(tidied(run), SIGNATURE)


def _table_keys(groups: int) -> Column:
    at = F.col("table")
    return F.xxhash64(
        at, F.get("half", (at / groups).cast("int")), F.get("half", groups + at % groups)
    )


def _hub_rows(keyed: DataFrame) -> DataFrame:
    """One pass over the sorted table keys: (key, id, hub) of every member of a shared bucket.

    The hub is the bucket's smallest id and has no row of its own. Only the last key is carried from
    batch to batch, so a bucket of any size streams through.
    """

    def run(batches):
        key, hub = None, 0
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            if not len(keys):
                continue
            fresh = np.ones(len(keys), bool)
            fresh[1:] = keys[1:] != keys[:-1]
            fresh[0] = key is None or keys[0] != key
            starts = np.flatnonzero(fresh)
            run_no = np.cumsum(fresh) - 1
            hubs = np.where(run_no >= 0, ids[starts[np.maximum(run_no, 0)]] if len(starts) else 0, hub)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[~fresh]), pa.array(ids[~fresh]), pa.array(hubs[~fresh].astype(np.int64))],
                ["key", "id", "hub"],
            )
            key, hub = keys[-1], hubs[-1]

    return (
        keyed.repartition("key").sortWithinPartitions("key", "id")
        .mapInArrow(tidied(run), "key long, id long, hub long")
    )


def _sets(docs: DataFrame, wanted: DataFrame, width: int, groups: int) -> DataFrame:
    """(id, shingles) of the wanted classes: rows of id (of the class), member, h1, h2, n_shingles.

    A class's set is taken from a text of the row id ``member``; its other texts have other digests.
    """
    flip = _constants(groups)[0][0]

    def run(batches):
        for batch in batches:
            for part in steps(batch, "text", STEP):
                sets, sizes = shingle_sets(*byte_view(part.column("text")), width)
                digest = _digests(sets, sizes, flip)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(sizes.astype(np.int64)), pa.array(digest[0].view(np.int64)),
                     pa.array(digest[1].view(np.int64)), lists(sets.view(np.int64), sizes, pa.int64())],
                    ["member", "n_shingles", "h1", "h2", "shingles"],
                )

    members = wanted.select(F.col("member").alias("id")).distinct()
    count = wanted.count()
    chosen = docs.select("id", "text").join(bounded_broadcast(members, count), "id", "left_semi")
    sets = chosen.mapInArrow(tidied(run), "member long, n_shingles long, h1 long, h2 long, shingles array<long>")
    return (
        sets.join(bounded_broadcast(wanted, count), ["member", *CLASS])
        .select("id", "shingles").dropDuplicates(["id"])
    )


def _confirmed(
    docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int, groups: int
) -> DataFrame:
    """The pairs (u, v) with 100 * intersection >= percent * union on the full sets."""
    ids = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    wanted = saved(classes.drop("half").join(ids, "id"), "pair-ids")
    sets = saved(_sets(docs, wanted, width, groups), "pair-sets")
    left = sets.select(F.col("id").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("id").alias("v"), F.col("shingles").alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    return (
        pairs.join(left, "u").join(right, "v").withColumn("common", common)
        .where(100 * F.col("common") >= percent * (F.size("a") + F.size("b") - F.col("common")))
        .select("u", "v")
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
    percent: int = SIMILARITY, groups: int = GROUPS,
) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept. See ``near_duplicate_rows``."""
    rows = near_duplicate_rows(docs, id_col, text_col, width, percent, groups)
    return rows.select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def near_duplicate_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
    percent: int = SIMILARITY, groups: int = GROUPS,
) -> DataFrame:
    """One row per document: id, k (xxhash64 of the text), n_shingles, component_id, kept.

    Documents link when 100 * intersection >= percent * union of their ``width``-word shingle sets;
    component_id is the smallest id reachable by links, kept tells the document of that id.

    Equal sets are one node from the start, so copies never meet in a bucket. Every member of a
    bucket is compared with the bucket's smallest id; buckets whose members are then still in more
    than one component are compared in full, in blocks, so no link that joins two components is left
    out, whatever the bucket's size.

    Null or empty texts have no shingles and stand alone. Rows with a null id take no part: they
    come back with a null component and kept true. Each text of a repeated id is a document of its
    own, told apart by k; rows of one component and its id are all kept. Other columns are ignored; an empty table gives no rows.
    """
    text = F.col(text_col)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("k"))
    sig = saved(signatures(docs, width, groups), "signatures")
    # ids of classes are numbers of their own: several texts of one document id are several classes
    classes = saved(
        sig.where("n_shingles > 0 and id is not null").groupBy(CLASS)
        .agg(F.min("id").alias("member"), F.first("half").alias("half"))
        .withColumn("id", F.monotonically_increasing_id()), "classes",
    )
    keyed = (
        classes.select("id", "half", F.explode(F.sequence(F.lit(0), F.lit(groups * groups - 1))).alias("table"))
        .select(_table_keys(groups).alias("key"), "id")
    )
    hubs = saved(_hub_rows(keyed), "hubs")
    pairs = saved(hubs.select(F.col("id").alias("u"), F.col("hub").alias("v")).where("u != v").distinct(), "pairs")
    links = saved(_confirmed(docs, classes, pairs, width, percent, groups), "links")
    linked = saved(components(links), "linked")
    merged = components(_cross_links(docs, classes, hubs, linked, width, percent, groups))
    merged = merged.select(F.col("node").alias("part"), F.col("component").alias("whole"))
    found = (
        classes.select(*CLASS, "id", "member").join(linked, F.col("id") == F.col("node"), "left")
        .join(merged, F.coalesce("component", "id") == F.col("part"), "left")
        .select(*CLASS, "member", F.coalesce("whole", "component").alias("component"))
    )
    # a class without links is its own component
    joined = saved(found.where("component is not null").select(*CLASS, "member", "component"), "joined")
    least = saved(joined.groupBy("component").agg(F.min("member").alias("root")), "least")
    roots = joined.join(bounded_broadcast(least, least.count()), "component").select(*CLASS, "root").unionByName(
        found.where("component is null").select(*CLASS, F.col("member").alias("root"))
    )
    out = sig.select("id", "k", *CLASS).join(roots, CLASS, "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
    return out.select(
        "id", "k", "n_shingles", component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def _cross_links(
    docs: DataFrame, classes: DataFrame, hubs: DataFrame, found: DataFrame, width: int, percent: int, groups: int
) -> DataFrame:
    """Links between different components that meet in a bucket of three or more, as (u, v) of the components.

    The members of such buckets form clusters (connected by buckets). A cluster is dealt into blocks,
    and each pair of blocks is compared as a product of two incidence matrices, from which only links
    come back.
    """
    members = hubs.select("key", "id").unionByName(hubs.select("key", F.col("hub").alias("id")).distinct())
    placed = (
        members.join(bounded_broadcast(found, found.count(), NEAR_ROWS), F.col("id") == F.col("node"), "left")
        .select("key", "id", F.coalesce("component", "id").alias("component"))
    )
    open_keys = (
        placed.groupBy("key")
        .agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"),
             F.min("id").alias("first"))
        .where("n > 2 and low < high").select("key", "first")
    )
    open_rows = saved(
        placed.join(open_keys, "key").select("id", "component", "first").distinct(), "open-rows"
    )
    clusters = components(open_rows.select(F.col("id").alias("u"), F.col("first").alias("v")))
    # one class has one component and one cluster
    ids = saved(
        open_rows.select("id", "component").distinct()
        .join(clusters.select(F.col("node").alias("id"), F.col("component").alias("cluster")), "id"), "open-ids",
    )
    wanted = saved(classes.drop("half").join(ids.select("id"), "id"), "open-classes")
    sets = saved(_sets(docs, wanted, width, groups).join(ids, "id"), "open-sets")
    blocks = sets.groupBy("cluster").agg(
        F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum(F.size("shingles")) / BLOCK_SHINGLES)).alias("blocks")
    )
    dealt = (
        sets.join(blocks, "cluster").withColumn("own", F.pmod(F.xxhash64("id"), "blocks"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select(
            "cluster", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
            (F.col("own") <= F.col("other")).alias("left"), "id", "component", "shingles",
        )
    )
    return dealt.groupBy("cluster", "low", "high").applyInArrow(_block_links(percent), "u long, v long")


def _block_links(percent: int):
    def run(group: pa.Table) -> pa.Table:
        left = group.column("left").to_numpy()
        parts = group.column("component").to_numpy()
        rows = group.column("shingles").combine_chunks()
        sizes = np.diff(rows.offsets.to_numpy())
        _, code, uses = np.unique(rows.flatten().to_numpy(), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(parts)), sizes)
        shared = uses[code] > 1
        owner, code = owner[shared], code[shared]
        order = np.argsort(code, kind="stable")
        owner, code = owner[order], code[order]
        column = np.cumsum(np.append(True, code[1:] != code[:-1])[:len(code)]) - 1
        same = group.column("low")[0].as_py() == group.column("high")[0].as_py()
        a = np.flatnonzero(left)
        b = a if same else np.flatnonzero(~left)
        common = np.zeros((len(a), len(b)), np.float32)
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, SLICE):
            i, j = np.searchsorted(column, [start, start + SLICE])
            seen = np.zeros((len(parts), SLICE), np.float32)
            seen[owner[i:j], column[i:j] - start] = 1
            common += seen[a] @ seen[b].T
        common = common.astype(np.int64)
        union = sizes[a][:, None] + sizes[b][None, :] - common
        hit = (100 * common >= percent * union) & (parts[a][:, None] != parts[b][None, :])
        u, v = np.nonzero(hit)
        pairs = np.unique(np.stack([parts[a[u]], parts[b[v]]]), axis=1)
        return pa.table({"u": pairs[0], "v": pairs[1]})

    return run
