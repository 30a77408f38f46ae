"""Passage corpora: nested JSON files to one row per passage, and the stored index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from ..functions import text as T
from ..functions import vectors as V
from ..functions import references as R


def _alternatives(fields: list[str], kind: t.DataType) -> list[t.StructField]:
    return [t.StructField(name, kind) for name in fields]


def _nested(text_type: t.DataType) -> t.ArrayType:
    item = t.StructType(
        [*_alternatives(["verse", "verse_number"], t.IntegerType()), t.StructField("text", text_type),
         t.StructField("verseText", t.StringType())]
    )
    section = t.StructType(
        [*_alternatives(["chapter", "chapter_number"], t.IntegerType()),
         t.StructField("verses", t.ArrayType(item))]
    )
    work = t.StructType(
        [*_alternatives(["book", "name", "bookName"], t.StringType()),
         t.StructField("chapters", t.ArrayType(section))]
    )
    return t.ArrayType(work)


def _read(spark: SparkSession, path: str, body: t.ArrayType) -> DataFrame:
    """Whole files as rows with `works`; the top level may be an object or a bare list."""
    raw = spark.read.text(path, wholetext=True)
    top = t.StructType(
        [t.StructField("version", t.StringType()),
         t.StructField("versions", t.ArrayType(t.StringType())), t.StructField("books", body)]
    )
    is_list = F.ltrim("value").startswith("[")
    wrapped = F.when(is_list, F.concat(F.lit('{"books":'), "value", F.lit("}"))).otherwise(F.col("value"))
    return raw.select(F.from_json(wrapped, top).alias("d"), F.col("_metadata.file_path").alias("_file")).select("d.*", "_file")


def _flatten(df: DataFrame) -> DataFrame:
    df = df.withColumn("b", F.explode("books")).withColumn("c", F.explode("b.chapters"))
    df = df.select("*", F.posexplode("c.verses").alias("pos", "v"))
    return df.withColumns(
        {
            "work": F.coalesce("b.book", "b.name", "b.bookName"),
            "section": F.coalesce("c.chapter", "c.chapter_number", F.lit(0)),
            "item": F.coalesce("v.verse", "v.verse_number", F.lit(0)),
        }
    )


def read_edition(spark: SparkSession, path: str, edition: str | None = None) -> DataFrame:
    """One edition per file: `edition, work, section, item, text`; blank texts are dropped."""
    df = _flatten(_read(spark, path, _nested(t.StringType())))
    version = F.coalesce(F.nullif("version", F.lit("")), F.lit(edition or ""))
    text = T.clean_trim(F.coalesce(F.nullif("v.text", F.lit("")), "v.verseText", F.lit("")))
    return df.select(
        T.edition_code(version).alias("edition"), "work", "section", "item", text.alias("text")
    ).filter(F.col("text") != "")


def read_editions(spark: SparkSession, path: str) -> DataFrame:
    """Several editions per file: the text is a map, or a string of the first declared edition.

    Work names that are not canonical are resolved by alias where possible. The last text of a
    repeated key wins: by file name, then by place in the file.
    """
    df = _flatten(_read(spark, path, _nested(t.StringType())))
    raw = F.trim("v.text")
    texts = F.from_json(F.when(raw.startswith("{"), raw), "map<string,string>")
    first = F.coalesce(F.get("versions", 0), F.lit(""))
    entries = F.coalesce(F.map_entries(texts), F.array(F.struct(first.alias("key"), raw.alias("value"))))
    df = df.withColumn("_nr", F.struct("_file", F.monotonically_increasing_id()))  # a file is one row, in order
    df = df.select("work", "section", "item", "_nr", F.explode(entries).alias("e"))
    df = df.select(
        T.edition_code(F.col("e.key")).alias("edition"), "work", "section", "item",
        T.clean_trim(F.coalesce("e.value", F.lit(""))).alias("text"), "_nr",
    ).filter(F.col("text") != "")
    df = R.resolve_works(df, "work", "_canon").withColumn("work", F.coalesce("_canon", "work"))
    return df.groupBy("edition", "work", "section", "item").agg(F.max_by("text", "_nr").alias("text"))


def union_editions(*editions: DataFrame) -> DataFrame:
    out = editions[0]
    for other in editions[1:]:
        out = out.unionByName(other)
    return out


def passage_key(*cols: Column) -> Column:
    """Stable 64-bit id of a passage, independent of partitioning."""
    return F.xxhash64(*cols)


def with_reference(passages: DataFrame) -> DataFrame:
    return passages.withColumn(
        "reference", T.reference(F.col("work"), F.col("section"), F.col("item"))
    )


def write_index(
    passages: DataFrame, path: str, embedder=None, limit: int | None = None
) -> None:
    """Embed passages and store vectors and metadata in one table, so they cannot diverge."""
    if limit:
        passages = passages.orderBy("work", "section", "item", "edition").limit(limit)
    embedder = embedder or V.BowEmbedder()
    df = with_reference(passages).withColumn(
        "passage_id", passage_key("edition", "work", "section", "item")
    )
    df.withColumn("vec", V.embed_column(embedder, F.col("text"), False)).write.mode("overwrite").partitionBy(
        "edition"
    ).parquet(path)


def read_index(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """Stored passages; fails if the row count is not the expected one."""
    df = spark.read.parquet(path)
    if expected is not None:
        found = df.count()
        if found != expected:
            raise ValueError(f"index holds {found} passages, expected {expected}")
    return df
