"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelake.llm.common import bounded_broadcast, saved

NEAR_ROWS = 100_000  # smallest neighbours that are sent to all tasks instead of joined by shuffle


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v): component is the smallest node reachable.

    Each round is two aggregates with map-side combine and two joins; no neighbour list is ever
    collected. While the edges counted are few, the joins move no edge. Rounds are written to the shared
    folder. Rows with a null end and loops are ignored; without edges the result is empty.
    """
    now = saved(
        edges.select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
        ).where("u > v").distinct(), "edges",
    )
    mark = _mark(now)
    while mark[0]:
        now = saved(_small_star(_large_star(now, mark[0]), mark[0]), "edges")
        fresh = _mark(now)
        if fresh == mark:
            break
        mark = fresh
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Rows may repeat, but never number more than the edges."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (
        both.join(bounded_broadcast(least, 2 * n, NEAR_ROWS), "u").where("v > u")
        .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    )


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """The edge to a node's smallest neighbour stays; its other smaller neighbours get edges to that one."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return (
        edges.join(bounded_broadcast(least, n, NEAR_ROWS), "u")
        .select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        .distinct()
    )
