"""Streaming queries over the driver tables, run to the end of the available files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import live
from ..session import checkpoint_root
from ..sources import transcripts
from ..streaming import jobs, stateful
from . import bindings as B
from . import live_queries, text_queries
from .bindings import query


def _replayed(events, name, slices=4, pause="1 day"):
    """The events as a stream of many files out of order, one per trigger.

    Slices of event time are written in swapped pairs (1, 0, 3, 2 ...), each dealt to two files, so rows
    arrive up to two slices late. The lateness covers that. A last row, far ahead in a stream of its own,
    moves the watermark past everything, as the next events of a running system would.
    """
    spark = events.sparkSession
    home = f"{checkpoint_root(spark)}/quotelake-{name}-{uuid.uuid4().hex}"
    low, high = events.agg(F.min("event_time"), F.max("event_time")).first()
    width = max(1, -(-int((high - low).total_seconds() + 1) // slices))
    part = F.floor((F.unix_micros("event_time") - F.unix_micros(F.lit(low))) / (width * 1_000_000))
    for number in range(slices + slices % 2):
        rows = events.filter(part == (number ^ 1))
        rows.repartition(2).write.mode("append").parquet(home)
    lateness = f"{3 * width} seconds"
    ahead = F.lit(high) + F.expr(f"INTERVAL {6 * width} SECONDS") + F.expr(f"INTERVAL {pause}") * 3
    closing = spark.range(1).select(*[
        {"stream_id": F.lit("~"), "seq": F.lit(0), "event_time": ahead}.get(f.name, F.lit(None))
        .cast(f.dataType).alias(f.name) for f in events.schema
    ])
    closing.write.mode("append").parquet(home)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(home)
    # a file is one task: its rows are dealt to all cores before the work on their texts
    return stream.repartition(spark.sparkContext.defaultParallelism).withWatermark("event_time", lateness)


def _finish(df, name):
    """Run a streaming query over everything available and read back what its sink holds."""
    spark = df.sparkSession
    home = f"{checkpoint_root(spark)}/quotelake-{name}-{uuid.uuid4().hex}"
    jobs.run(
        df, f"{name}_{uuid.uuid4().hex}", jobs.once_per_epoch(f"{home}/out"),
        checkpoint=f"{home}/state", available_now=True,
    ).awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{home}/out/epoch=*")


def _clock(turn):
    """A turn every ten seconds; not from the epoch on, where the first watermark stands."""
    return F.timestamp_seconds(F.col(turn) * 10 + 1_000_000)


def _log(spark, sf):
    log = B.live_log(spark, sf)
    return log.withColumns({
        "stream_id": F.col("stream_id").cast("string"), "event_time": F.col("ts").cast("timestamp"),
    })


@query(text_queries.ORACLE_OVERLAP_EXACT)
def stream_overlap_trim(spark, sf):
    rows = text_queries._overlapping(spark, sf).select(
        F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").alias("seq"),
        _clock("turn").alias("event_time"), "text",
    )
    out = _finish(stateful.trim_overlaps(_replayed(rows, "overlap")), "overlap_trim")
    return out.select(
        F.col("stream_id").cast("long").alias("conv_id"), F.col("seq").alias("turn"), "dropped", "trimmed"
    )


@query(f"""
WITH {B.LIVE_LOG}
SELECT e.stream_id, e.seq, count(a.seq) AS waiting FROM log e LEFT JOIN log a ON a.stream_id = e.stream_id AND a.kind = 'queue_add' AND a.seq <= e.seq
  AND NOT EXISTS (SELECT 1 FROM log b WHERE b.stream_id = a.stream_id AND b.seq > a.seq AND b.seq <= e.seq AND (b.kind = 'queue_clear' OR (b.kind = 'queue_remove' AND b.item = a.item)))
GROUP BY ALL
""")
def stream_queue_sizes(spark, sf):
    out = _finish(stateful.queue_changes(_replayed(_log(spark, sf), "queue")), "queue_sizes")
    return out.select(F.col("stream_id").cast("long").alias("stream_id"), "seq", "waiting")


@query(live_queries.ACCUMULATED + "SELECT stream_id, acc AS text FROM l")
def stream_quotes(spark, sf):
    """Quotations, closed by an end mark, an opener, another intent or silence."""
    rows = _session_rows(spark, sf).filter("out_kind = 'quote'")
    return rows.select(F.col("stream_id").cast("long").alias("stream_id"), "text")


@query()
def stream_live_session(spark, sf):
    return _session_rows(spark, sf)


def _session_rows(spark, sf):
    none = F.lit(None)
    events = live_queries._routed_turns(spark, sf).select(
        F.col("stream_id").cast("string"), F.col("seg_id").alias("seq"),
        _clock("seg_id").alias("event_time"), F.lit("segment").alias("kind"), "text",
        F.lit(True).alias("is_final"), none.cast("string").alias("edition"), none.cast("string").alias("work"),
        none.cast("int").alias("section"), none.cast("int").alias("item"),
    )
    return _finish(stateful.live_session(_replayed(events, "session")), "live_session")


def _segment_events(spark, sf):
    return B.segments(spark, sf).select(
        F.col("stream_id").cast("string"), F.col("seg_id").alias("seq"), _clock("seg_id").alias("event_time"),
        "text", "start_time", "end_time",
    )


@query(text_queries.SENTENCE_WINDOWS)
def stream_windows(spark, sf):
    """Windows of a growing stream, each once: the rows of `sentence_windows`."""
    out = _finish(stateful.sentence_windows(_replayed(_segment_events(spark, sf), "windows", slices=8)), "windows")
    return out.select(
        F.col("stream_id").cast("long").alias("stream_id"), F.col("seq").alias("seg_id"), "sent_id", "candidate_text",
        "prev_text", "next_text", "text", "start_time", "end_time",
    )


@query(f"""
WITH {B.SEGMENTS}, whole AS (SELECT stream_id, 1 AS o, string_agg({B.sql_trim('text')}, ' ' ORDER BY seg_id) AS text
  FROM segments WHERE {B.sql_trim('text')} <> '' GROUP BY stream_id),
{text_queries.WINDOW_SQL.format(keys="stream_id", order="o", source="whole")}
SELECT stream_id, sent_id, candidate_text, prev_text, next_text, text FROM windows
""")
def stream_joined_windows(spark, sf):
    """Windows of sentences that may run over segments."""
    events = _replayed(_segment_events(spark, sf), "joined", slices=8)
    out = _finish(stateful.sentence_windows(events, joined=True), "joined_windows")
    return out.select(
        F.col("stream_id").cast("long").alias("stream_id"), "sent_id", "candidate_text", "prev_text", "next_text", "text"
    )


@query(live_queries.MODE_GATE)
def stream_mode_gate(spark, sf):
    log = _log(spark, sf).select(
        "stream_id", "seq", "event_time", live_queries.mode_named().alias("mode"),
        (F.col("kind") == "present").alias("is_final"), "confidence",
    )
    return _finish(stateful.mode_gates(_replayed(log, "modes")), "mode_gate").drop("stream_id")


@query(live_queries.DISPLAY_STATE)
def stream_display_state(spark, sf):
    """Kept up to date per micro-batch: every epoch rewrites the newest row of each stream."""
    shown = stateful.display_changes(_replayed(_log(spark, sf), "display"), "kind", "item")
    home = f"{checkpoint_root(spark)}/quotelake-display-{uuid.uuid4().hex}"
    done = jobs.run(
        shown, f"display_{uuid.uuid4().hex}", jobs.latest(f"{home}/out", "stream_id", "as_of"), mode="update",
        checkpoint=f"{home}/state", available_now=True,
    )
    done.awaitTermination()
    out = jobs.read_latest(spark, done, f"{home}/out", shown.schema)
    return out.select(F.col("stream_id").cast("long").alias("stream_id"), "as_of", "shown")


@query(rf"""
WITH RECURSIVE m AS (SELECT *, conv_id + turn AS n FROM conversations WHERE (conv_id + turn) % 13 <> 0),
x AS MATERIALIZED (SELECT conv_id, turn, n % 11 = 0 AS closing, CASE WHEN n % 7 = 0 THEN '' ELSE {B.sql_trim('text')} END AS text,
  n % 2 = 0 AS is_final, n % 3 = 0 AS speech_final, turn * 10.0::DOUBLE AS start_time, turn * 10.0::DOUBLE + 2.5 AS end_time,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM m WHERE n % 11 = 0 OR n % 7 <> 0),
f AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS r, NULL::BIGINT AS turn, NULL::STRUCT(t VARCHAR, s DOUBLE, e DOUBLE) AS held, []::STRUCT(t VARCHAR, s DOUBLE, e DOUBLE)[] AS out FROM x
  UNION ALL
  SELECT conv_id, r, turn,
    CASE WHEN closing OR (is_final AND NOT (same AND NOT speech_final)) THEN NULL WHEN same THEN {{'t': text, 's': held.s, 'e': end_time}} ELSE fresh END,
    CASE WHEN closing THEN shut WHEN is_final AND same AND NOT speech_final THEN [] WHEN is_final AND same THEN [fresh]
      WHEN is_final THEN list_append(shut, fresh) WHEN same THEN [] ELSE shut END
  FROM (SELECT x.*, f.held, coalesce(abs(f.held.s - x.start_time) < 0.5, FALSE) AS same, {{'t': x.text, 's': x.start_time, 'e': x.end_time}} AS fresh,
      CASE WHEN f.held IS NULL THEN [] ELSE [f.held] END AS shut FROM f JOIN x ON x.conv_id = f.conv_id AND x.r = f.r + 1)),
rows_out AS (SELECT conv_id, turn, unnest(out) AS o FROM f UNION ALL
  SELECT conv_id, turn, held FROM (SELECT *, max(r) OVER (PARTITION BY conv_id) AS last FROM f) WHERE r = last AND held IS NOT NULL)
SELECT conv_id::VARCHAR AS stream_id, turn AS seq, o.t AS text, o.s AS start_time, o.e AS end_time, NULL::VARCHAR AS words FROM rows_out
""")
def stream_utterances(spark, sf):
    raw = live_queries._messages_of(B.table(spark, sf, "conversations"))
    rows = transcripts.parse_messages(raw).select(
        F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").alias("seq"),
        _clock("turn").alias("event_time"), "type", "text",
        "start_time", "end_time", "is_final", "speech_final",
    )
    return _finish(stateful.assemble_utterances(_replayed(rows, "messages")), "utterances")


@query(f"""
WITH {B.LIVE_LOG}
SELECT kind, time_bucket(INTERVAL 86400 SECONDS, ts, TIMESTAMP '1970-01-01') AS chunk_start, count(*) AS n, coalesce(sum(value) / nullif(sum(item), 0), 0) > 0.95 AS lagging FROM log GROUP BY ALL
""")
def stream_progress(spark, sf):
    """Windowed metrics in append mode: a window is written once the watermark has passed it."""
    log = _replayed(_log(spark, sf), "progress")
    out = _finish(live.progress_metrics(log, ["kind"], "event_time", "value", "item", 86400.0), "progress")
    return out.select("kind", F.col("chunk_start").cast("timestamp_ntz").alias("chunk_start"), "n", "lagging")
