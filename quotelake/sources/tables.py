"""CSV and JSON-lines readers and writers of the labelling and training jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T



def read_ragged_csv(spark: SparkSession, path: str) -> DataFrame:
    """Four-column CSV whose text may hold unquoted commas.

    The last three fields are aligned to the right, the rest is the text; short rows are padded.
    `line` counts from 1 with the header on line 1.
    """
    raw = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"),
        F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("pos", "row"),
    )
    quoted = r'("(?:[^"]|"")*"|[^,]*)(?:,|$)'
    fields = F.regexp_extract_all("row", F.lit(quoted), 1)
    # the pattern also matches the empty end of a row that does not end in a comma
    fields = F.when(F.col("row").endswith(","), fields).otherwise(
        F.slice(fields, 1, F.greatest(F.size(fields) - 1, F.lit(1)))
    )
    plain = F.transform(
        fields, lambda f: F.replace(F.regexp_replace(f, r'^"|"$', ""), F.lit('""'), F.lit('"'))
    )
    df = raw.filter("pos > 0").withColumn("_f", plain)
    n = F.size("_f")
    text = F.when(n > 4, F.array_join(F.slice("_f", 1, n - 3), ",")).otherwise(F.get("_f", 0))
    verse = F.when(n > 4, F.get("_f", n - 3)).otherwise(F.get("_f", 1))
    label = F.when(n > 4, F.get("_f", n - 1)).otherwise(F.get("_f", 3))

    def clean(c):
        return T.clean_trim(F.coalesce(c, F.lit("")))

    return df.select(
        "file", (F.col("pos") + 1).cast("long").alias("line"), clean(text).alias("text"),
        clean(verse).alias("verse"), clean(label).alias("label"),
    )


def read_labelled_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def read_first_column(spark: SparkSession, path: str) -> DataFrame:
    """First column of a CSV without header and blank rows."""
    df = spark.read.option("multiLine", True).option("escape", '"').csv(path)
    text = T.clean_trim(F.coalesce(F.col(df.columns[0]), F.lit("")))
    return df.select(text.alias("text")).filter((F.col("text") != "") & (F.lower("text") != "text"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; broken lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def export_csv(spark: SparkSession, source: str, target: str, schema: str, columns: list[str]) -> None:
    """JSON lines to CSV with the given columns."""
    write_csv(read_json_lines(spark, source, schema).select(*columns), target)


def write_split(rows: DataFrame, path: str, flag: str = "is_validation") -> None:
    write_csv(rows.filter(~F.col(flag)).drop(flag), f"{path}/train")
    write_csv(rows.filter(F.col(flag)).drop(flag), f"{path}/validation")


def write_records(records: DataFrame, path: str) -> None:
    """Nested result records as JSON lines; no records give an empty folder, not a failure."""
    records.write.mode("overwrite").json(path)
