"""Transcript ingest with a ledger: every file of a folder is read once, with its outcome on record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from . import transcripts

LEDGER = "path string, name string, safe_id string, status string, error string, n_segments int, attempt long"


def _parsed(raw: DataFrame) -> DataFrame:
    """Files with their segments or the reason why there are none."""
    name = F.element_at(F.split("path", "/"), -1)
    df = raw.withColumns({
        "name": F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))),
        "f": F.from_json("value", transcripts.FILE_SCHEMA),
    })
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    error = F.when(F.try_parse_json("value").isNull(), "not JSON").when(
        F.col("f.segments").isNull(), "no segments"
    )
    return df.select(
        "path", "name", T.safe_identifier(stem).alias("safe_id"), stem.alias("stream_id"), "f.*", error.alias("error"),
        F.when(error.isNull(), "ok").otherwise("error").alias("status"),
    )


def _record(raw: DataFrame, out: str, ledger: str, run: str, attempt: int) -> None:
    """Write segments and outcomes of some files to folders of this run: a replay overwrites itself."""
    files = _parsed(raw).persist()
    n_segments = F.when(F.col("status") == "ok", F.size("segments"))
    entries = files.select(
        "path", "name", "safe_id", "status", "error", n_segments.alias("n_segments"),
        F.lit(attempt).cast("long").alias("attempt"),
    )
    transcripts.segments(files).write.mode("overwrite").parquet(f"{out}/run={run}")
    entries.write.mode("overwrite").parquet(f"{ledger}/run={run}")  # last: what it lists is there
    files.unpersist()


def ingest_files(
    spark: SparkSession, folder: str, out: str, ledger: str, checkpoint: str, available_now: bool = True,
    files_per_trigger: int = 1000,
) -> StreamingQuery:
    """Stream a folder of transcript files: each new file once, over restarts too.

    Segments go to `out`, outcomes to `ledger`. A file that cannot be read is on record with status
    `error` and does not stop the others; it is not read again until `retry_failed` asks for it.
    """
    reader = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger)
    raw = reader.text(folder).select("value", F.col("_metadata.file_path").alias("path"))

    def write(df: DataFrame, epoch: int) -> None:
        _record(df, out, ledger, f"epoch-{epoch}", 0)

    writer = raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def ledger_rows(spark: SparkSession, ledger: str) -> DataFrame:
    """The latest outcome of every file."""
    rows = spark.read.schema(LEDGER).parquet(f"{ledger}/run=*")
    latest = rows.groupBy("path").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "path"]), "attempt").alias("r"))
    return latest.select("path", "r.*")


def retry_failed(spark: SparkSession, out: str, ledger: str) -> int:
    """Read the files again whose last outcome is an error; the number of files tried."""
    failed = ledger_rows(spark, ledger).filter("status = 'error'")
    attempt = (failed.agg(F.max("attempt")).first()[0] or 0) + 1
    paths = [r["path"] for r in failed.select("path").collect()]  # file names, as any listing holds them
    if paths:
        raw = spark.read.option("wholetext", True).text(paths).select("value", F.col("_metadata.file_path").alias("path"))
        _record(raw, out, ledger, f"retry-{attempt}", attempt)
    return len(paths)


def ingested_segments(spark: SparkSession, out: str, ledger: str) -> DataFrame:
    """Segments of the files that the ledger has as ok."""
    good = ledger_rows(spark, ledger).filter("status = 'ok'")
    ids = good.select(F.regexp_replace("name", r"\.[^.]*$", "").alias("stream_id")).distinct()
    return spark.read.parquet(f"{out}/run=*").join(ids, "stream_id", "left_semi")
