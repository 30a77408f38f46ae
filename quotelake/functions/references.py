"""Parsing of spoken and written references, and alias resolution by small fixed dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicons as L


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, group), F.lit(""))


def parse_with(text: Column, pattern: str) -> dict[str, Column]:
    return {
        "ref_token": _part(text, pattern, 1),
        "ref_section": _part(text, pattern, 2).cast("int"),
        "ref_item": _part(text, pattern, 3).cast("int"),
    }


def spoken_reference(text: Column) -> dict[str, Column]:
    """Work token, section and item of the first spoken reference; nulls if there is none."""
    return parse_with(text, L.SPOKEN_REF_PATTERN)


def string_reference(text: Column) -> dict[str, Column]:
    """`Work c:v` anywhere in a reference string."""
    return parse_with(text, L.STRING_REF_PATTERN)


def strict_reference(text: Column) -> dict[str, Column]:
    """A label-file reference: the whole string must be `Work c:v` or `Work c.v`."""
    return parse_with(F.regexp_replace(F.trim(text), r"[.,;]+$", ""), L.STRICT_REF_PATTERN)


def alias_frame(spark: SparkSession, table: dict[str, str], key: str, value: str) -> DataFrame:
    """A fixed alias table as a DataFrame; its size is the size of the lexicon."""
    return spark.createDataFrame(sorted(table.items()), f"{key} string, {value} string")


def resolve_works(df: DataFrame, token: str, out: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """Canonical work of a spoken token: as is, without punctuation, then without blanks."""
    dim = alias_frame(df.sparkSession, aliases or L.work_aliases(), "_alias", "_work")
    key = F.lower(F.trim(F.col(token)))
    # the literal dimension is a few hundred rows by construction, so broadcasting is bounded
    steps = {
        "_k1": key,
        "_k2": F.trim(F.regexp_replace(key, r"[^\p{L}\p{N}\s]", "")),
        "_k3": F.regexp_replace(key, r"[^\p{L}\p{N}]", ""),
    }
    df = df.withColumns(steps)
    for i, k in enumerate(steps, 1):
        side = F.broadcast(dim.select(F.col("_alias").alias(k), F.col("_work").alias(f"_w{i}")))
        df = df.join(side, k, "left")
    found = F.coalesce(*[F.col(f"_w{i}") for i in range(1, 4)])
    return df.withColumn(out, found).drop("_k1", "_k2", "_k3", "_w1", "_w2", "_w3")


def resolve_edition(name: Column) -> Column:
    """Edition code of a spoken alias or a code, or null. The table is a fixed literal map."""
    both = {k.lower(): v for k, v in L.EDITION_CODES.items() if k != "NEW KING JAMES VERSION"}
    both.update(L.EDITION_ALIASES)
    return F.try_element_at(literal_map(both), F.lower(F.trim(name)))


def literal_map(table: dict) -> Column:
    """A constant map, parsed once from one SQL expression."""
    def sql(value) -> str:
        return str(value) if isinstance(value, int) else "'" + value.replace("'", "\\'") + "'"

    return F.expr("map(" + ", ".join(f"{sql(k)}, {sql(v)}" for k, v in table.items()) + ")")


def _named(low: Column, templates: list[str]) -> Column:
    """Every alias a template can capture is in the table, so the first capture decides."""
    found = [_part(low, t.replace("{e}", L.EDITION_ALTERNATION), 1) for t in templates]
    return resolve_edition(F.coalesce(*found))


def named_edition(text: Column, broad: bool = False) -> Column:
    """Edition named by the first swap template that matches (and, if asked, the broad one)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return _named(low, L.SWAP_TEMPLATES + ([L.SWAP_BROAD] if broad else []))


def broadly_named_edition(text: Column) -> Column:
    return _named(F.lower(F.coalesce(text, F.lit(""))), [L.SWAP_BROAD])


def work_titles(df: DataFrame, token: str, out: str, works: DataFrame) -> DataFrame:
    """Label-file rule: alias table first, else the title-cased token if that work exists."""
    spark = df.sparkSession
    dim = F.broadcast(alias_frame(spark, L.label_aliases(), "_alias", "_w1"))
    known = works.select(F.col("work").alias("_title")).distinct().withColumn("_w2", F.col("_title"))
    df = df.withColumn("_alias", F.regexp_replace(F.lower(F.trim(F.col(token))), r"\s+", " "))
    df = df.withColumn("_title", F.initcap(F.col("_alias")))
    df = df.join(dim, "_alias", "left").join(known, "_title", "left")
    return df.withColumn(out, F.coalesce("_w1", "_w2")).drop("_alias", "_title", "_w1", "_w2")
