"""Streaming jobs: start a query, detect quotations per micro-batch, publish the event feed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import live, router
from ..plans import detection
from ..session import checkpoint_root
from . import stateful
from .sources import LATENESS


def run(
    df: DataFrame, name: str, batch: Callable[[DataFrame, int], None], mode: str = "append",
    checkpoint: str | None = None, available_now: bool = False,
) -> StreamingQuery:
    """Start a query with a checkpoint in the shared checkpoint folder."""
    where = checkpoint or f"{checkpoint_root(df.sparkSession)}/streams/{name}"
    writer = (
        df.writeStream.queryName(name).outputMode(mode).foreachBatch(batch)
        .option("checkpointLocation", where)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


def once_per_epoch(path: str) -> Callable[[DataFrame, int], None]:
    """Sink that writes each micro-batch to its own folder, so a replay overwrites itself."""
    def write(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def latest(path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """Sink of an update-mode query: a table that holds the newest row of every key.

    The table of an epoch is made from that of the one before, so a replay gives the same table; `read_latest`
    finds the last one.
    """
    def write(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        if epoch:
            df = df.unionByName(spark.read.schema(df.schema).parquet(f"{path}/epoch={epoch - 1}"))
        keep = [F.max_by(c, order).alias(c) for c in df.columns if c != key]
        df.groupBy(key).agg(*keep).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def read_latest(spark: SparkSession, query: StreamingQuery, path: str, schema) -> DataFrame:
    """The table after the last epoch of a query that wrote with `latest`."""
    return spark.read.schema(schema).parquet(f"{path}/epoch={query.lastProgress['batchId']}")


def window_feed(segments: DataFrame, path: str, name: str = "windows", joined: bool = True, **kw) -> StreamingQuery:
    """Write every sentence window of final segments once; `read_windows` streams them on."""
    return run(stateful.sentence_windows(segments, joined=joined), name, once_per_epoch(path), **kw)


def read_windows(spark: SparkSession, path: str, lateness: str = LATENESS) -> DataFrame:
    """The windows that `window_feed` has written as a stream of events to route."""
    windows = spark.readStream.schema(stateful.WINDOW_OUT).parquet(f"{path}/epoch=*")
    return stateful.windows_as_events(windows).withWatermark("event_time", lateness)


def detect_batch(passages: DataFrame, out: str) -> Callable[[DataFrame, int], None]:
    """Resolve commands and detect quotations of one micro-batch of the live session."""
    def work(df: DataFrame, epoch: int) -> None:
        key = F.concat_ws("-", "stream_id", "seq", "out_kind")
        df = df.withColumn("utt_id", key).persist()  # the state is read once, the branches share it
        quotes = df.filter("out_kind = 'quote'").select("utt_id", "stream_id", "seq", "text")
        found = detection.detect_utterances(quotes.select("utt_id", "text"), passages)
        found = found.join(quotes.withColumnRenamed("text", "transcript"), "utt_id")
        commands = df.filter("out_kind IN ('nav', 'explicit')").select(
            "utt_id", "text", "a_edition", "a_work", "a_section", "a_item"
        )
        shown = router.route(commands, passages).filter(F.col("reason").isNull())
        shown = shown.drop("available").join(df.select("utt_id", "stream_id", "seq"), "utt_id")
        sessions = df.groupBy("stream_id").agg(F.max_by("mode", "seq").alias("mode"), F.max("seq").alias("as_of"))
        feed = live.event_feed(
            quotes, found, shown, df.filter("out_kind = 'clear'").select("stream_id", "seq"), sessions
        )
        feed.write.mode("overwrite").json(f"{out}/epoch={epoch}")
        df.unpersist()

    return work


def detect_live(
    session_rows: DataFrame, passages: DataFrame, out: str, name: str = "detect_live", **kw
) -> StreamingQuery:
    return run(session_rows, name, detect_batch(passages, out), **kw)
