"""Near-duplicate vectors by a forest of random-projection trees with spill overlap.

A level of a tree projects on one random direction; each node splits near the median of its vectors, and
vectors within a margin of the split go both ways. Vectors are compared only within leaves, and those of
an overfull leaf in blocks. A pair is counted in the first leaf that it shares, so no list of pairs is
ever made. The splits are fitted on a bounded sample; every vector is indexed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelake.llm.common import lists, ragged, saved
from quotelake.llm.components import components

SAMPLE, LEAF, BLOCK = 20_000, 256, 128
LEAF_BITS = 24


@dataclass(frozen=True)
class Forest:
    """Split values per (label, dimension) and tree, as heaps; directions follow from the seed."""

    trees: int
    depth: int
    margin: float
    seed: int
    splits: dict[tuple[int, int], np.ndarray]


def directions(forest: Forest, dimension: int) -> np.ndarray:
    """Unit direction per tree and level."""
    rng = np.random.Generator(np.random.PCG64([forest.seed, dimension]))
    d = rng.standard_normal((forest.trees, max(forest.depth, 1), dimension))
    return d / np.linalg.norm(d, axis=2, keepdims=True)


def fit_forest(vectors: DataFrame, similarity: float, trees: int, leaf: int, sample: int, seed: int = 11) -> Forest:
    """Fit on about ``sample`` vectors (id, label, vector), chosen by a digest of the id."""
    sizes = vectors.groupBy("label").agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
    total, most = sizes[0] or 0, sizes[1] or 0
    scale = 1 << 30
    rate = min(scale, scale * sample // max(total, 1))
    rows = (
        vectors.where(F.pmod(F.xxhash64("id"), F.lit(scale)) < rate).select("label", "vector").collect()
    )
    groups: dict[tuple[int, int], list] = {}
    for r in rows:
        groups.setdefault((r["label"], len(r["vector"])), []).append(r["vector"])
    depth = int(np.ceil(max(0.0, np.log(max(most, 1) / leaf) / np.log(1.75))))
    largest = max((len(g) for g in groups.values()), default=1)
    depth = min(depth, max(0, int(np.log2(max(largest, 1) / 8))), LEAF_BITS - 4)
    margin = 0.8 * float(np.sqrt(2 * (1 - similarity)))
    forest = Forest(trees, depth, margin, seed, {})
    for key, group in groups.items():
        x = np.array(group, float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        rng = np.random.Generator(np.random.PCG64([seed, len(x), 1]))
        forest.splits[key] = np.stack([_splits(x @ d.T, depth, rng) for d in directions(forest, key[1])])
    return forest


def _splits(projected: np.ndarray, depth: int, rng: np.random.Generator) -> np.ndarray:
    """Heap of split values: a random quantile around the median of the sample in each node."""
    heap = np.zeros((1 << depth) - 1)
    node = np.zeros(len(projected), np.int64)
    for level in range(depth):
        value = projected[:, level]
        for k in range(1 << level):
            own = value[node == k]
            if len(own):
                heap[(1 << level) - 1 + k] = np.quantile(own, rng.uniform(0.4, 0.6))
        node = 2 * node + (value >= heap[(1 << level) - 1 + node])
    return heap


def leaves_of(forest: Forest, splits: np.ndarray | None, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf code) of every leaf that each unit vector falls in; codes are unique over trees."""
    margin = forest.margin / np.sqrt(x.shape[1])
    rows, codes = [], []
    for tree, d in enumerate(directions(forest, x.shape[1])):
        value = x @ d.T
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for level in range(forest.depth):
            at = (1 << level) - 1 + node
            split = splits[tree][at] if splits is not None else np.zeros(len(at))
            p = value[row, level]
            left, right = p < split + margin, p >= split - margin
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
        rows.append(row)
        codes.append((tree << LEAF_BITS) + node)
    row, code = np.concatenate(rows), np.concatenate(codes)
    order = np.lexsort((code, row))
    return row[order], code[order]


def _dealt(classes: DataFrame, forest: Forest) -> DataFrame:
    """A row per class and leaf: leaf, all leaves of the class, and its vector."""

    def run(batches):
        for batch in batches:
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            column = batch.column("vector")
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.values.to_numpy(zero_copy_only=False)
            starts = column.offsets.to_numpy()[:-1]
            for label, size in set(zip(labels.tolist(), sizes.tolist())):
                own = np.flatnonzero((labels == label) & (sizes == size))
                x = flat[starts[own][:, None] + np.arange(size)].astype(float)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                row, code = leaves_of(forest, forest.splits.get((label, size)), x)
                count = np.bincount(row, minlength=len(own))
                first = np.cumsum(count) - count
                part = batch.take(pa.array(own[row]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(code), lists(code[ragged(first[row], count[row])], count[row], pa.int64()), part.column("id"),
                     part.column("label"), part.column("copies"), part.column("vector")],
                    ["leaf", "leaves", "id", "label", "copies", "vector"],
                )

    return classes.select("id", "label", "copies", "vector").mapInArrow(
        run, "leaf long, leaves array<long>, id long, label long, copies long, vector array<double>"
    )


def _compare(similarity: float):
    def run(group: pa.Table) -> pa.Table:
        ids, copies = group.column("id").to_numpy(), group.column("copies").to_numpy()
        left, leaf = group.column("left").to_numpy(), group.column("leaf")[0].as_py()
        rows = group.column("vector").combine_chunks()
        x = rows.flatten().to_numpy().reshape(len(ids), -1)
        same = group.column("low")[0].as_py() == group.column("high")[0].as_py()
        a = np.flatnonzero(left)
        b = a if same else np.flatnonzero(~left)
        norm = np.sqrt((x * x).sum(1))
        hit = (x[a] @ x[b].T) / (norm[a][:, None] * norm[b][None, :]) >= similarity
        if same:
            hit = np.triu(hit, 1)
        u, v = np.nonzero(hit)
        u, v = a[u], b[v]
        if not len(u):
            return pa.table({"id": ids[:0], "links": copies[:0], "root": ids[:0]})
        live = np.unique(np.concatenate([u, v]))
        # count a pair only where it has no earlier leaf in common
        codes = group.column("leaves").combine_chunks()
        owner = np.repeat(np.arange(len(ids)), np.diff(codes.offsets.to_numpy()))
        code = codes.flatten().to_numpy()
        place = np.full(len(ids), -1)
        place[live] = np.arange(len(live))
        use = (code < leaf) & (place[owner] >= 0)
        _, column = np.unique(code[use], return_inverse=True)
        seen = np.zeros((len(live), int(column.max()) + 1 if len(column) else 1), np.float32)
        seen[place[owner[use]], column] = 1
        first = (seen @ seen.T)[place[u], place[v]] == 0
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, u[first], copies[v[first]])
        np.add.at(links, v[first], copies[u[first]])
        root, before = ids.copy(), None
        while before is None or (root != before).any():
            before = root.copy()
            np.minimum.at(root, u, before[v])
            np.minimum.at(root, v, before[u])
        return pa.table({"id": ids[live], "links": links[live], "root": root[live]})

    return run


def vector_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    similarity: float = 0.98, trees: int = 4, leaf: int = LEAF, sample: int = SAMPLE,
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors of equal label link when their cosine in double precision is at least ``similarity``.
    Equal vectors of a label are one node with a count. A null or zero vector, one with a null or
    non-finite component, and one with a null label link with nothing; vectors of different length are
    not compared. Rows with a null id take no part: no links, a null component, kept. Repeated rows are
    vectors of their own with the same id. Other columns are ignored; an empty table gives no rows.
    """
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vector.alias("vector")
    )
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    infinite = F.lit(float("inf"))
    # a null or NaN component makes the sum null or NaN, an infinite one infinite
    fine = (
        F.col("id").isNotNull() & F.col("label").isNotNull()
        & F.coalesce((square > 0) & (square < infinite) & ~F.isnan(square), F.lit(False))
    )
    rows = rows.withColumn("fine", fine).withColumns(
        {"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(1), "vector")}
    )
    good = rows.where("fine")
    keys = ["label", "h1", "h2"]
    classes = saved(
        good.groupBy(*keys).agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("vector").alias("vector")),
        "vector-classes",
    )
    forest = fit_forest(classes, similarity, trees, leaf, sample)
    dealt = saved(_dealt(classes, forest), "leaves")
    key = ["label", "leaf", "size"]
    dealt = dealt.withColumn("size", F.size("vector"))
    blocks = dealt.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    paired = (
        dealt.join(blocks, key).withColumn("own", F.pmod(F.xxhash64("id"), "blocks"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select(
            *key, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
            (F.col("own") <= F.col("other")).alias("left"), "id", "copies", "leaves", "vector",
        )
    )
    compared = saved(
        paired.groupBy(*key, "low", "high").applyInArrow(_compare(similarity), "id long, links long, root long"),
        "vector-links",
    )
    found = components(compared.select(F.col("id").alias("u"), F.col("root").alias("v")))
    counts = compared.groupBy("id").agg(F.sum("links").alias("links"))
    classes = (
        classes.select(*keys, "id", "copies").join(counts, "id", "left")
        .join(found, F.col("id") == F.col("node"), "left")
        .select(*keys, F.coalesce("component", "id").alias("root"),
                (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    )
    out = rows.select("id", "fine", *keys).join(
        classes.withColumn("fine", F.lit(True)), ["fine", *keys], "left"
    )
    component = F.coalesce("root", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )
