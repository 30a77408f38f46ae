"""Batch forms of the live operators: chunks, utterances, cue accumulation, votes, states.

They run over a finished event log and give the same rows as the streaming queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from .. import lexicons as L
from ..functions import text as T
from . import ordered, router
from .ordered import CHUNK, Axis


def chunk_windows(
    ts: Column, seconds: float = C.CHUNK_SECONDS, overlap: float = 0.0
) -> Column:
    """Time window of a row: fixed chunks, or chunks preceded by `overlap` seconds."""
    if not overlap:
        return F.window(ts, f"{seconds} seconds")
    return F.window(ts, f"{seconds + overlap} seconds", f"{seconds} seconds", f"{seconds - overlap} seconds")


def chunk_counts(events: DataFrame, keys: list[str], ts: str, seconds: float, overlap: float = 0.0) -> DataFrame:
    w = chunk_windows(F.col(ts), seconds, overlap)
    return events.groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n")).select(
        *keys, F.col("w.start").alias("chunk_start"), F.col("w.end").alias("chunk_end"), "n"
    )


def progress_metrics(
    events: DataFrame, keys: list[str], ts: str, busy: str, total: str, seconds: float
) -> DataFrame:
    """Rows, processed seconds and lag flag per key and chunk."""
    w = F.window(ts, f"{seconds} seconds")
    out = events.groupBy(*keys, w.alias("w")).agg(
        F.count("*").alias("n"), F.sum(busy).alias("busy"), F.sum(total).alias("total")
    )
    ratio = F.coalesce(F.try_divide("busy", "total"), F.lit(0.0))
    return out.select(
        *keys, F.col("w.start").alias("chunk_start"), "n", "busy", "total",
        (ratio > C.LAG_RATIO).alias("lagging"),
    )


def stage_metrics(events: DataFrame, stage: str, busy: str, total: str) -> DataFrame:
    """Average time per stage and ratio of sums."""
    return events.groupBy(F.col(stage).alias("stage")).agg(
        F.count("*").alias("n"), F.avg(busy).alias("avg_busy"),
        F.coalesce(F.try_divide(F.sum(busy), F.sum(total)), F.lit(0.0)).alias("ratio"),
    )


def utterance_islands(
    updates: DataFrame, stream: str, seq: str, at: Column, text: str,
    gap: float = C.UTTERANCE_GAP_SECONDS, width: int = 65536,
) -> DataFrame:
    """Updates whose start times follow within `gap` belong to one utterance; the last text wins."""
    axis = Axis((stream,), (seq,), width)
    df = updates.withColumn("_at", at)
    df = ordered.carry_last(axis.cut_long(df), axis, {"_before": F.col("_at")})
    fresh = F.coalesce((F.col("_at") - F.col("_before") >= gap).cast("long"), F.lit(1))
    df = ordered.running_sum(df, axis, fresh, "utterance", inclusive=True)
    return df.groupBy(stream, "utterance").agg(
        F.min("_at").alias("start_time"), F.max("_at").alias("end_time"),
        F.count("*").alias("n_updates"), F.max_by(text, seq).alias("text"),
    )


def accumulate_cues(
    utterances: DataFrame, stream: str, seq: str, text: str = "text", width: int = 65536
) -> DataFrame:
    """Join quotation text over pauses.

    A quotation is closed by terminal punctuation, by any other intent, or by a new opener.
    Whether one is open before a row depends only on the last row that can change it, so the
    borders are a carried value and the texts of one quotation are folded in order: a text that
    contains or is contained in the collected one replaces it, any other is appended.
    """
    axis = Axis((stream,), (seq,), width)
    df = router.classify(utterances, text)
    cue = (F.col("intent") == router.CUE) & (T.word_count(F.col(text)) >= C.MIN_WORDS)
    other = F.col("intent") != router.CUE
    ends = F.col(text).rlike(L.SENTENCE_END_PATTERN)
    df = df.withColumn("_cue", cue).withColumn("_shut", F.when(other, True).when(cue, ends))
    df = ordered.carry_last(df, axis, {"_was_shut": F.col("_shut")})
    opener = F.lower(F.col(text)).rlike(L.QUOTE_OPENER_PATTERN)
    starts = F.col("_cue") & (F.coalesce("_was_shut", F.lit(True)) | opener)
    df = ordered.running_sum(df, axis, starts.cast("long"), "quote_no", inclusive=True)
    parts = F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(seq).alias("q"), F.col(text).alias("t")))),
        lambda p: p["t"],
    )
    joined = df.filter("_cue").groupBy(stream, "quote_no").agg(
        parts.alias("_parts"), F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq")
    )
    text_out = F.aggregate(
        F.slice("_parts", 2, F.size("_parts")),
        F.get("_parts", 0),
        lambda acc, t: F.when(F.contains(acc, t) | F.contains(t, acc), t).otherwise(
            F.concat(acc, F.lit(" "), t)
        ),
    )
    return joined.withColumn("candidate_text", text_out).withColumn(
        "n_parts", F.size("_parts")
    ).drop("_parts")


def vote(variant_best: DataFrame, keys: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """Best query variant per text with the agreement boost.

    Input: one row per (text, variant_no) with `reference`, `confidence` and the columns to carry from
    the winner. The first strictly highest confidence wins; n variants that agree on its reference add
    0.03 (n-1), at most 0.12. A text has few variants, so its list is small.
    """
    packed = variant_best.groupBy(*keys).agg(
        F.array_sort(
            F.collect_list(
                F.struct((-F.col("confidence")).alias("o"), "variant_no", "confidence", "reference", *carry)
            )
        ).alias("_v")
    )
    best = F.get(F.col("_v"), 0)
    agree = F.size(F.filter("_v", lambda v: v["reference"] == best["reference"]))
    boost = F.least(F.lit(C.AGREEMENT_CAP), C.AGREEMENT_STEP * (agree - 1))
    return packed.select(
        *keys, best["reference"].alias("reference"), best["variant_no"].alias("variant_no"),
        agree.alias("agree"), *[best[c].alias(c) for c in carry],
        F.least(F.lit(1.0), best["confidence"] + F.when(agree >= 2, boost).otherwise(0.0)).alias("confidence"),
    )


def live_floor(df: DataFrame, floor: float = C.LIVE_CONFIDENCE_FLOOR) -> DataFrame:
    return df.filter(F.col("confidence") >= floor)


def as_of_anchor(
    events: DataFrame, stream: str, seq: str, shown: Column, value: Column, width: int = 65536
) -> DataFrame:
    """Last displayed value before each row; clear events do not reset it."""
    axis = Axis((stream,), (seq,), width)
    df = ordered.carry_last(axis.cut_long(events), axis, {"anchor": F.when(shown, value)})
    return df.drop(CHUNK)


def gate_by_mode(
    events: DataFrame, stream: str, seq: str, mode: Column, initial: str = "semi_autopilot",
    width: int = 65536,
) -> DataFrame:
    """Mode in force at each row; `mode` is null on rows that do not change it.

    Input in manual mode is refused; only autopilot presents final, eligible detections.
    """
    axis = Axis((stream,), (seq,), width)
    df = ordered.carry_last(axis.cut_long(events), axis, {"_m": mode}).drop(CHUNK)
    df = df.withColumn("mode", F.coalesce("_m", F.lit(initial))).drop("_m")
    accepted = F.col("mode") != "manual"
    presented = (
        (F.col("mode") == "autopilot") & F.col("is_final")
        & (F.col("confidence") >= C.AUTOPILOT_THRESHOLD)
    )
    return df.withColumns({"accepted": accepted, "presented": presented})


def display_state(events: DataFrame, stream: str, seq: str, kind: str, value: str) -> DataFrame:
    """What each stream shows now: the last present or clear event decides."""
    relevant = events.filter(F.col(kind).isin("present", "clear"))
    last = relevant.groupBy(stream).agg(
        F.max_by(F.struct(kind, value), seq).alias("_s"), F.max(seq).alias("as_of")
    )
    shown = F.when(F.col(f"_s.{kind}") == "present", F.col(f"_s.{value}"))
    return last.select(stream, "as_of", shown.alias("shown"))


def queue_state(events: DataFrame, stream: str, seq: str, kind: str, item: str) -> DataFrame:
    """Queue left after add, remove(item) and clear events.

    An add survives if no later clear of the stream and no later remove of the item exists; both
    limits are plain aggregates.
    """
    adds = events.filter(F.col(kind) == "queue_add").select(stream, item, seq)
    clears = events.filter(F.col(kind) == "queue_clear").groupBy(stream).agg(F.max(seq).alias("_c"))
    removes = events.filter(F.col(kind) == "queue_remove").groupBy(stream, item).agg(F.max(seq).alias("_r"))
    df = adds.join(clears, stream, "left").join(removes, [stream, item], "left")
    none = F.lit(-1)
    return df.filter(
        (F.col(seq) > F.coalesce("_c", none)) & (F.col(seq) > F.coalesce("_r", none))
    ).drop("_c", "_r")


def event_feed(
    transcripts: DataFrame, detections: DataFrame, displays: DataFrame, queue: DataFrame,
    sessions: DataFrame | None = None,
) -> DataFrame:
    """Typed feed rows `(type, payload)`; detections carry a whole-number percentage."""
    def typed(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(name).alias("type"), F.to_json(F.struct("*")).alias("payload"))

    percent = F.floor(F.col("confidence") * 100 + F.lit(0.5)).cast("int")
    feed = (
        typed(transcripts, "transcript_update")
        .unionByName(typed(detections.withColumn("confidence_percent", percent), "detection"))
        .unionByName(typed(displays, "display_update"))
        .unionByName(typed(queue, "queue_update"))
    )
    return feed if sessions is None else feed.unionByName(typed(sessions, "session_update"))
