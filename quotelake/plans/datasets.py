"""Data-set jobs: labelling set, label cleaning, train/validation split, synthetic validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labels, records, synthetic, training
from ..sources import tables, transcripts


def labelling_set(files: DataFrame) -> DataFrame:
    """Transcript files (with `words`, `starts`, `ends`) -> suggested label rows."""
    broken = labels.thin_breaks(labels.break_positions(files))
    rows = labels.suggest(labels.build_lines(broken))
    return rows.select(
        F.col("stream_id").alias("source_file"), "line_no",
        records.round_at(F.col("start_time"), 2).alias("start_time"),
        records.round_at(F.col("end_time"), 2).alias("end_time"),
        "text", "matched_trigger", records.round_at(F.col("auto_score"), 2).alias("auto_score"),
        "label", "subtype",
    )


def build_labelling_csv(spark: SparkSession, transcripts_path: str, out: str) -> None:
    files = transcripts.file_words(transcripts.read_transcripts(spark, transcripts_path))
    tables.write_csv(labelling_set(files).orderBy("source_file", "line_no"), out)


def clean_labels(rows: DataFrame, names: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(clean rows, dropped rows): consistent labels and anonymised source names."""
    good, dropped = labels.repair_labels(rows)
    return good.withColumn("source_file", labels.anonymise(F.col("source_file"), names)), dropped


def prepare_split(rows: DataFrame, order: str, fraction: float = 0.10) -> DataFrame:
    return training.stratified_split(training.keep_first_texts(rows, order), fraction=fraction)


def validate_synthetic(
    rows: DataFrame, passages: DataFrame, order: str, existing: DataFrame | None = None,
    targets: dict[str, int] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, drop counts): validation, duplicate check and quotas in arrival order."""
    checked = synthetic.validate(rows, passages)
    good = checked.filter(F.col("drop_reason").isNull())
    accepted = synthetic.accept_fresh(good, order, targets=targets, existing=existing)
    return accepted, synthetic.drop_counts(checked)
