"""Direct lookups over the passage table: by reference, by edition, by section, and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C

REF = ["work", "section", "item"]


def exact_lookup(refs: DataFrame, passages: DataFrame, how: str = "left") -> DataFrame:
    """Text of (edition, work, section, item). The join strategy is left to Spark's size checks."""
    table = passages.select("edition", *REF, F.col("text").alias("passage_text"))
    return refs.join(table, ["edition", *REF], how)


def existing(refs: DataFrame, passages: DataFrame) -> DataFrame:
    return refs.join(passages, ["edition", *REF], "left_semi")


def missing(refs: DataFrame, passages: DataFrame) -> DataFrame:
    return refs.join(passages, ["edition", *REF], "left_anti")


def editions_per_reference(passages: DataFrame) -> DataFrame:
    """Sorted editions of every reference."""
    return passages.groupBy(*REF).agg(F.array_sort(F.collect_set("edition")).alias("editions"))


def texts_per_reference(passages: DataFrame) -> DataFrame:
    """Reference -> {edition: text}; the group is bounded by the number of editions."""
    return passages.groupBy(*REF).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("edition", "text")))).alias("texts")
    )


def pivot_editions(passages: DataFrame, editions: list[str]) -> DataFrame:
    return passages.groupBy(*REF).pivot("edition", editions).agg(F.first("text"))


def with_fallback(
    refs: DataFrame, passages: DataFrame, ref_id: str, default: str | Column = C.DEFAULT_EDITION
) -> DataFrame:
    """Requested edition, else the default, else the first by name. Unmatched refs are kept.

    Rows without a whole reference get a join key of their own, so they do not all meet in one partition.
    """
    default = F.lit(default) if isinstance(default, str) else default
    table = passages.select(
        F.col("work").alias("_work"), F.col("section").alias("_section"), F.col("item").alias("_item"),
        F.col("edition").alias("found_edition"),
        F.col("text").alias("_t"),
    )
    whole = F.col("work").isNotNull() & F.col("section").isNotNull() & F.col("item").isNotNull()
    own_key = F.concat(F.lit("\u0000"), F.col(ref_id).cast("string"))
    joined = (
        refs.withColumn("_default", default)
        .withColumn("_work", F.when(whole, F.col("work")).otherwise(own_key))
        .withColumns({"_section": F.coalesce("section", F.lit(-1)), "_item": F.coalesce("item", F.lit(-1))})
        .join(table, ["_work", "_section", "_item"], "left")
    )
    priority = F.struct(
        F.when(F.col("found_edition") == F.col("edition"), 0)
        .when(F.col("found_edition") == F.col("_default"), 1)
        .otherwise(2),
        "found_edition",
    )
    keep = [c for c in refs.columns if c != ref_id]
    best = joined.groupBy(ref_id).agg(
        *[F.first(c).alias(c) for c in keep],
        F.min_by(F.struct("found_edition", "_t"), priority).alias("_b"),
        F.array_sort(F.collect_set("found_edition")).alias("available"),
    )
    return best.withColumns(
        {"found_edition": F.col("_b.found_edition"), "passage_text": F.col("_b._t")}
    ).drop("_b")


def max_item(passages: DataFrame) -> DataFrame:
    return passages.groupBy("work", "section").agg(F.max("item").alias("max_item"))


def max_section(passages: DataFrame) -> DataFrame:
    return passages.groupBy("work").agg(F.max("section").alias("max_section"))


def read_sections(
    requests: DataFrame, passages: DataFrame, default: str = C.DEFAULT_EDITION
) -> DataFrame:
    """Items of requested (edition, work, section); an empty section falls back to the default."""
    rows = passages.select("edition", "work", "section", "item", "text")
    own = requests.join(rows, ["edition", "work", "section"])
    empty = requests.join(rows, ["edition", "work", "section"], "left_anti")
    fallback = empty.drop("edition").join(
        rows.filter(F.col("edition") == default), ["work", "section"]
    )
    return own.unionByName(fallback.select(own.columns))


def step_target(anchors: DataFrame, passages: DataFrame) -> DataFrame:
    """Where a navigation action leads, with section wrap; null when it leaves the work.

    Needs `action` in next_verse, prev_verse, next_chapter, prev_chapter and the anchor columns.
    Only the two small maxima tables are joined; the target passage is looked up afterwards.
    """
    here = max_item(passages).select("work", "section", F.col("max_item").alias("_here"))
    before = max_item(passages).select(
        "work", (F.col("section") + 1).alias("section"), F.col("max_item").alias("_before")
    )
    df = (
        anchors.join(here, ["work", "section"], "left")
        .join(before, ["work", "section"], "left")
        .join(max_section(passages), "work", "left")
    )
    section, item = F.col("section"), F.col("item")
    wraps_on = item + 1 > F.coalesce("_here", F.lit(0))
    has_next = section + 1 <= F.coalesce("max_section", F.lit(0))
    has_prev = (section - 1 >= 1) & F.col("_before").isNotNull()
    target = (
        F.when(F.col("action") == "next_verse",
               F.when(~wraps_on, F.struct(section.alias("s"), (item + 1).alias("i")))
               .when(has_next, F.struct((section + 1).alias("s"), F.lit(1).alias("i"))))
        .when(F.col("action") == "prev_verse",
              F.when(item - 1 >= 1, F.struct(section.alias("s"), (item - 1).alias("i")))
              .when(has_prev, F.struct((section - 1).alias("s"), F.col("_before").alias("i"))))
        .when(F.col("action") == "next_chapter",
              F.when(has_next, F.struct((section + 1).alias("s"), F.lit(1).alias("i"))))
        .when(F.col("action") == "prev_chapter",
              F.when(has_prev, F.struct((section - 1).alias("s"), F.col("_before").alias("i"))))
    )
    return df.withColumn("_t", target).withColumns(
        {"to_section": F.col("_t.s"), "to_item": F.col("_t.i")}
    ).drop("_t", "_here", "_before", "max_section")
