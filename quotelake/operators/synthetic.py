"""Validation of generated training rows: drop reasons, quotation check, duplicates, quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from .. import lexicons as L
from ..functions import references as R
from ..functions import text as T
from . import ordered
from .ordered import CHUNK, Axis


def passage_word_sets(passages: DataFrame) -> DataFrame:
    """Content word sets per edition of each reference; the list is bounded by the editions."""
    return passages.groupBy("work", "section", "item").agg(
        F.collect_list(T.content_set(F.col("text"))).alias("_sets")
    )


def validate(rows: DataFrame, passages: DataFrame, targets: dict[str, int] | None = None) -> DataFrame:
    """Add `drop_reason` (null for good rows), canonical `verse` and the label of the subtype.

    Reasons are tested in order: bad_text, bad_subtype, verse_unresolved, quote_mismatch. A row
    whose `text` could not be parsed at all is not_object.
    """
    targets = targets or L.SUBTYPE_TARGETS
    text = T.clean_trim(F.coalesce("text", F.lit("")))
    sub = F.trim(F.coalesce("subtype", F.lit("")))
    df = rows.withColumns({"text": text, "subtype": sub, **R.strict_reference(F.col("verse"))})
    df = R.work_titles(df, "ref_token", "work", passages)
    # rows whose reference did not resolve get join keys of their own, so they do not meet in one task
    whole = F.col("work").isNotNull() & F.col("ref_section").isNotNull() & F.col("ref_item").isNotNull()
    df = df.withColumn(
        "_key", F.when(whole, F.concat_ws("\u0000", "work", "ref_section", "ref_item"))
        .otherwise(F.concat(F.lit("\u0000"), F.md5(F.concat_ws("|", "text", "verse", "subtype"))))
    )
    sets = passage_word_sets(passages).select(F.concat_ws("\u0000", "work", "section", "item").alias("_key"), "_sets")
    df = df.join(sets, "_key", "left").drop("_key")
    known = F.col("_sets").isNotNull()
    overlap = F.array_max(
        F.transform("_sets", lambda s: T.content_overlap(s, T.content_set(F.col("text"))))
    )
    positive = F.col("subtype").isin(L.POSITIVE_SUBTYPES)
    is_object = F.col("is_object") if "is_object" in rows.columns else F.lit(True)
    reason = (
        F.when(~is_object, "not_object")
        .when((F.col("text") == "") | (F.length("text") > C.MAX_TEXT_CHARS), "bad_text")
        .when(~F.col("subtype").isin(list(targets)), "bad_subtype")
        .when(positive & ~known, "verse_unresolved")
        .when(
            (F.col("subtype") == "direct_quote_chopped")
            & (F.coalesce(overlap, F.lit(0)) < C.MIN_QUOTE_OVERLAP),
            "quote_mismatch",
        )
    )
    return df.withColumns(
        {
            "drop_reason": reason,
            "verse": F.when(positive, T.reference(F.col("work"), F.col("ref_section"), F.col("ref_item")))
            .otherwise("0"),
            "label": F.when(positive, "positive").otherwise("negative"),
        }
    ).drop("ref_token", "ref_section", "ref_item", "work", "_sets")


def _digest(text: str):
    return F.md5(T.norm_text(F.col(text)))


def unseen(
    rows: DataFrame, existing: DataFrame | None, order: str, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """First row of every normalised text that `existing` does not hold yet.

    Texts meet as digests, and an aggregate with map-side combine keeps the first row, so copies of one
    text never meet in one window task. Only the columns in `keep`, else all, are shuffled with the digest.
    """
    df = rows.withColumn("_norm", _digest(text))
    if existing is not None:
        seen = existing.select(_digest(text).alias("_norm")).distinct()
        df = df.join(seen, "_norm", "left_anti")
    keep = keep or rows.columns
    first = df.groupBy("_norm").agg(F.min_by(F.struct(*keep), order).alias("_row"))
    return first.select("_row.*")


def accept_fresh(
    rows: DataFrame, order: str, targets: dict[str, int] | None = None,
    existing: DataFrame | None = None, text: str = "text", width: int = 65536,
) -> DataFrame:
    """Rows in arrival order whose text is new and whose subtype is not full.

    A text counts as seen once a row of it is accepted, so a copy of a text whose subtype was full may
    come in under another subtype. `order` is unique. Quotas fill up one after the other: with the
    places known at which the first ones were full, what comes in before the next one fills up is known
    too, so there are at most as many rounds as subtypes.
    """
    targets = dict(targets or L.SUBTYPE_TARGETS)
    slim = rows.select(order, "subtype", _digest(text).alias("_norm"))
    slim = slim.filter(F.col("subtype").isin(list(targets)))
    if existing is not None:
        seen = existing.select(_digest(text).alias("_norm")).distinct()
        slim = slim.join(seen, "_norm", "left_anti")
        used = {r["subtype"]: r["n"] for r in existing.groupBy("subtype").agg(F.count("*").alias("n")).collect()}
        targets = {k: n - used.get(k, 0) for k, n in targets.items()}
    full: dict[str, int] = {}
    slim = slim.filter(F.col("subtype").isin([k for k, n in targets.items() if n > 0])).persist()
    while True:
        open_ = F.lit(True)
        for subtype, last in full.items():
            open_ = open_ & ((F.col("subtype") != subtype) | (F.col(order) <= last))
        fresh = slim.filter(open_).groupBy("_norm").agg(F.min_by(F.struct(order, "subtype"), order).alias("_row"))
        ranked = ordered.dense_index(fresh.select("_row.*"), Axis(("subtype",), (order,), width), "_rank")
        quota = F.try_element_at(R.literal_map(targets), F.col("subtype"))
        ends = (
            ranked.filter((F.col("_rank") == quota - 1) & ~F.col("subtype").isin(list(full)))
            .select(order, "subtype").orderBy(order).limit(1).collect()  # the next quota to fill up
        )
        if not ends:
            break
        full[ends[0]["subtype"]] = ends[0][order]
    accepted = fresh.select(F.col(f"_row.{order}").alias(order))
    return rows.join(accepted, order, "left_semi")


def accept_quota(
    rows: DataFrame, order: str, targets: dict[str, int] | None = None,
    already: DataFrame | None = None, width: int = 65536,
) -> DataFrame:
    """Rows of a subtype in arrival order until its quota is full."""
    targets = targets or L.SUBTYPE_TARGETS
    quota = R.literal_map(targets)
    df = rows.withColumn("_quota", F.coalesce(F.try_element_at(quota, F.col("subtype")), F.lit(0)))
    if already is not None:
        used = already.groupBy("subtype").agg(F.count("*").alias("_used"))
        df = df.join(used, "subtype", "left").withColumn(
            "_quota", F.col("_quota") - F.coalesce("_used", F.lit(0))
        ).drop("_used")
    axis = Axis(("subtype",), (order,), width)
    kept = ordered.first_per_group(df, axis, F.col("_quota"))
    return kept.drop("_quota", "_rank", CHUNK)


def progress(accepted: DataFrame, targets: dict[str, int] | None = None) -> DataFrame:
    """Accepted and remaining rows per subtype."""
    targets = targets or L.SUBTYPE_TARGETS
    goals = accepted.sparkSession.createDataFrame(sorted(targets.items()), "subtype string, target long")
    counts = accepted.groupBy("subtype").agg(F.count("*").alias("accepted"))
    # the goals are the fixed subtype list
    return counts.join(F.broadcast(goals), "subtype", "right").select(
        "subtype", "target", F.coalesce("accepted", F.lit(0)).alias("accepted"),
        F.greatest(F.lit(0), F.col("target") - F.coalesce("accepted", F.lit(0))).alias("remaining"),
    )


def label_shares(accepted: DataFrame) -> DataFrame:
    """Accepted rows per label and their share of all."""
    counts = accepted.groupBy("label").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("label", "n", (F.col("n") / F.col("_total")).alias("share"))


def drop_counts(validated: DataFrame) -> DataFrame:
    return (
        validated.filter(F.col("drop_reason").isNotNull())
        .groupBy("drop_reason").agg(F.count("*").alias("n"))
    )


def seed_pool(passages: DataFrame) -> DataFrame:
    """Passages of 8 to 45 words."""
    n = T.word_count(F.col("text"))
    return passages.filter((n >= C.SEED_MIN_WORDS) & (n <= C.SEED_MAX_WORDS))
