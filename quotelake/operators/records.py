"""Result records, surfaced filter, and summaries of bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T


def round_at(value: Column, digits: int) -> Column:
    """Round half up with plain double arithmetic, the same on every engine."""
    unit = 10**digits
    return F.floor(value * F.lit(float(unit)) + F.lit(0.5)).cast("double") / F.lit(float(unit))


def build_records(df: DataFrame, keys: list[str], settings: C.Settings = C.Settings()) -> DataFrame:
    """One result record per window from its ranked candidates."""
    best = F.element_at("ranked", 1)
    confidence = T.clamp01(best["final"])

    def brief(c):
        return F.struct(
            T.reference(c["work"], c["section"], c["item"]).alias("reference"),
            c["edition"].alias("edition"), round_at(c["final"], 4).alias("score"),
        )

    return df.filter(F.size("ranked") > 0).select(
        *keys,
        round_at(F.col("start_time"), 2).alias("start_time"),
        round_at(F.col("end_time"), 2).alias("end_time"),
        F.col("candidate_text").alias("transcript"),
        round_at(F.col("quote_prob"), 4).alias("quote_probability"),
        T.reference(best["work"], best["section"], best["item"]).alias("selected_reference"),
        best["edition"].alias("edition"),
        round_at(confidence, 4).alias("confidence"),
        T.band(confidence).alias("confidence_band"),
        F.transform(F.slice("ranked", 1, settings.max_candidates), brief).alias("candidates"),
    )


def surfaced(records: DataFrame, include_ignored: bool = False) -> DataFrame:
    return records if include_ignored else records.filter(F.col("confidence_band") != C.BAND_IGNORED)


def band_counts(df: DataFrame, band: str = "confidence_band") -> DataFrame:
    return df.groupBy(F.col(band).alias("band")).agg(F.count("*").alias("n"))


def chronological(records: DataFrame) -> DataFrame:
    return records.orderBy("start_time", "sent_id")
