"""Transcript files, recognition messages and already-processed bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

WORD = "struct<text:string,start_time:double,end_time:double,probability:double>"
SEGMENT = (
    "struct<text:string,start_time:double,end_time:double,start:double,end:double,"
    f"words:array<{WORD}>>"
)
FILE_SCHEMA = (
    f"source_file string, transcribed_at string, word_timestamps boolean, segments array<{SEGMENT}>"
)
MESSAGE = (
    "struct<type:string,is_final:boolean,speech_final:boolean,start:double,duration:double,"
    "channel:struct<alternatives:array<struct<transcript:string,speech_final:boolean,"
    "words:array<struct<word:string,punctuated_word:string,start:double,end:double,"
    "confidence:double>>>>>>"
)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Files as rows; a file that cannot be parsed keeps a row with status `error`."""
    raw = spark.read.text(path, wholetext=True).select(
        F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1), r"\.[^.]*$", "")
        .alias("stream_id"),
        F.from_json("value", FILE_SCHEMA).alias("f"),
    )
    ok = F.col("f.segments").isNotNull()
    return raw.select("stream_id", "f.*", F.when(ok, "ok").otherwise("error").alias("status"))


def segments(files: DataFrame) -> DataFrame:
    """One row per segment; times may be called start/end and default to 0."""
    df = files.filter(F.col("status") == "ok") if "status" in files.columns else files
    df = df.select("stream_id", F.posexplode("segments").alias("seg_id", "s"))
    return df.select(
        "stream_id", F.col("seg_id").cast("long"),
        T.clean_trim(F.coalesce("s.text", F.lit(""))).alias("text"),
        F.coalesce("s.start_time", "s.start", F.lit(0.0)).alias("start_time"),
        F.coalesce("s.end_time", "s.end", F.lit(0.0)).alias("end_time"),
        F.coalesce("s.words", F.array().cast(f"array<{WORD}>")).alias("words"),
    )


def interpolated_words(segment_rows: DataFrame) -> DataFrame:
    """Word rows of each segment; a segment without words gets evenly spaced times."""
    toks = T.words(F.col("text"))
    step = (F.col("end_time") - F.col("start_time")) / F.greatest(F.size(toks), F.lit(1))
    spaced = F.transform(
        toks,
        lambda w, i: F.struct(
            w.alias("text"),
            (F.col("start_time") + i * step).alias("start_time"),
            (F.col("start_time") + (i + 1) * step).alias("end_time"),
        ),
    )
    timed = F.transform(
        "words",
        lambda w: F.struct(
            T.clean_trim(w["text"]).alias("text"),
            F.coalesce(w["start_time"], F.col("start_time")).alias("start_time"),
            F.coalesce(w["end_time"], F.col("end_time")).alias("end_time"),
        ),
    )
    has_words = F.size("words") > 0
    rows = F.filter(F.when(has_words, timed).otherwise(spaced), lambda w: w["text"] != "")
    df = segment_rows.select("stream_id", "seg_id", F.posexplode(rows).alias("pos", "w"))
    return df.select(
        "stream_id", "seg_id", "pos", F.col("w.text").alias("word"), "w.start_time", "w.end_time"
    )


def file_words(files: DataFrame) -> DataFrame:
    """Files with `words`, `starts`, `ends` arrays for line building."""
    rows = interpolated_words(segments(files))
    packed = rows.groupBy("stream_id").agg(
        F.array_sort(F.collect_list(F.struct("seg_id", "pos", "word", "start_time", "end_time"))).alias("w")
    )
    return packed.select(
        "stream_id", *[
            F.col("w").getField(f).alias(name)
            for f, name in [("word", "words"), ("start_time", "starts"), ("end_time", "ends")]
        ],
    )


def parse_messages(messages: DataFrame, column: str = "payload") -> DataFrame:
    """Recognition messages: segment fields, flags and words; malformed or empty ones are dropped.

    UtteranceEnd messages are kept as rows without text.
    """
    df = messages.withColumn("_m", F.from_json(column, MESSAGE))
    alt = F.get("_m.channel.alternatives", 0)
    text = T.clean_trim(F.coalesce(alt["transcript"], F.lit("")))
    words = F.transform(
        F.filter(alt["words"], lambda w: F.coalesce(F.nullif(w["punctuated_word"], F.lit("")), w["word"]) != ""),
        lambda w: F.struct(
            T.clean_trim(F.coalesce(F.nullif(w["punctuated_word"], F.lit("")), w["word"])).alias("text"),
            F.coalesce(w["start"], F.lit(0.0)).alias("start_time"),
            F.coalesce(w["end"], F.lit(0.0)).alias("end_time"),
            F.coalesce(w["confidence"], F.lit(1.0)).alias("probability"),
        ),
    )
    start = F.coalesce("_m.start", F.lit(0.0))
    df = df.withColumns(
        {
            "type": F.col("_m.type"), "text": text,
            "is_final": F.coalesce("_m.is_final", F.lit(True)),
            "speech_final": F.coalesce(alt["speech_final"], F.lit(False))
            | F.coalesce("_m.speech_final", F.lit(False)),
            "start_time": start, "end_time": start + F.coalesce("_m.duration", F.lit(0.0)),
            "words": words,
        }
    )
    result = (F.col("type") == "Results") & (F.col("text") != "")
    return df.filter(result | (F.col("type") == "UtteranceEnd")).drop("_m", column)


def pending(listing: DataFrame, processed: DataFrame, name: str = "name") -> DataFrame:
    """Files not processed yet, compared by their safe identifier."""
    stem = T.safe_identifier(F.regexp_replace(name, r"\.[^.]*$", ""))
    todo = listing.withColumn("safe_id", stem)
    return todo.join(processed.select("safe_id"), "safe_id", "left_anti")
