"""Streaming inputs: event files with an explicit schema, event time and a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

EVENT_SCHEMA = (
    "stream_id string, seq long, event_time timestamp, kind string, text string, is_final boolean, "
    "confidence double, edition string, work string, section int, item int"
)
LATENESS = "30 seconds"


def read_events(
    spark: SparkSession, path: str, schema: str = EVENT_SCHEMA, fmt: str = "json",
    files_per_trigger: int = 1000, lateness: str = LATENESS, time: str = "event_time",
) -> DataFrame:
    """Event stream from a folder. Pressure is bounded by the files per trigger: nothing is dropped."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).withWatermark(time, lateness)


def finals(events: DataFrame) -> DataFrame:
    return events.filter("is_final")


def interims(events: DataFrame) -> DataFrame:
    return events.filter("NOT is_final")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark and were dropped, over the batches whose progress Spark keeps.

    `session.build_session` keeps that of 100 000 batches.
    """
    return sum(
        int(op.get("numRowsDroppedByWatermark", 0))
        for progress in query.recentProgress for op in progress["stateOperators"]
    )
