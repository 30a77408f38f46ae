"""Triage of text rows against gold labels: suggestions, outcome counts and review order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T

OUT_COLUMNS = [
    "text", "verse", "label", "suggested_label", "suggested_verse", "confidence",
    "confidence_band", "quote_probability", "top_candidate", "confirmed_label",
    "confirmed_verse", "notes",
]


def split_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(gold, unlabelled, blank)."""
    label, text = F.coalesce("label", F.lit("")), F.coalesce("text", F.lit(""))
    return (
        rows.filter(label != ""),
        rows.filter((label == "") & (text != "")),
        rows.filter((label == "") & (text == "")),
    )


def suggestions(records: DataFrame) -> DataFrame:
    """Suggested label, reference and a printable top candidate for each record."""
    positive = F.col("confidence_band").isin(C.BAND_AUTOPILOT, C.BAND_REVIEW)
    top = F.get(F.col("candidates"), 0)
    return records.withColumns(
        {
            "suggested_label": F.when(positive, "positive").otherwise("negative"),
            "suggested_verse": F.when(positive, F.col("selected_reference")).otherwise("0"),
            "top_candidate": F.format_string("%s (%.2f)", top["reference"], top["score"]),
        }
    )


def outcome(gold: Column, suggested: Column) -> Column:
    return (
        F.when((gold == "positive") & (suggested == "positive"), "caught")
        .when(gold == "positive", "missed")
        .when(suggested == "negative", "rejected")
        .otherwise("flagged")
    )


def outcome_counts(rows: DataFrame, gold: str, suggested: str) -> DataFrame:
    o = outcome(F.lower(F.col(gold)), F.col(suggested))
    return rows.withColumn("outcome", o).groupBy("outcome").agg(F.count("*").alias("n"))


def wrong_rows(rows: DataFrame, gold: str, suggested: str) -> DataFrame:
    o = outcome(F.lower(F.col(gold)), F.col(suggested))
    return rows.withColumn("outcome", o).filter(F.col("outcome").isin("missed", "flagged"))


def review_order(rows: DataFrame) -> DataFrame:
    """Gold rows first in file order, then by band, confidence and line."""
    gold = F.coalesce(F.col("label"), F.lit("")) != ""
    return rows.orderBy(
        F.desc(gold),
        F.when(gold, F.lit(0)).otherwise(T.band_order(F.col("confidence_band"))),
        F.when(gold, F.lit(0.0)).otherwise(-F.coalesce("confidence", F.lit(0.0))),
        "line",
    )


def top_ignored(rows: DataFrame, n: int = 10) -> DataFrame:
    """The ignored rows of highest confidence, the likeliest misses (a top-n report)."""
    return (
        rows.filter(F.col("confidence_band") == C.BAND_IGNORED)
        .orderBy(F.desc("confidence"), "line").limit(n)
    )


def review_sheet(gold: DataFrame, triaged: DataFrame) -> DataFrame:
    """The twelve review columns; gold rows keep their label and blank suggestions."""
    def pad(df: DataFrame) -> DataFrame:
        have = set(df.columns)
        return df.withColumns(
            {c: F.lit(None).cast("string") for c in OUT_COLUMNS if c not in have}
        ).select("line", *[F.col(c).cast("string").alias(c) for c in OUT_COLUMNS if c != "confidence"],
                 F.col("confidence").cast("double").alias("confidence"))

    return review_order(pad(gold).unionByName(pad(triaged))).select(*OUT_COLUMNS)
