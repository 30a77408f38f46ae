"""The corpus pipeline: stages over documents, each written and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.llm.common import bounded_broadcast, saved, short_batches, table
from quotelake.llm.langid import fit, keep_identified
from quotelake.llm.lines import dedup_lines
from quotelake.llm.near_dup import near_duplicate_rows
from quotelake.llm.packing import pack_documents
from quotelake.llm.secrets import redact_secrets

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
COPY_SHARE = 0.2


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars brought up to the text."""
    size = F.length("text").cast("long")
    return docs.withColumn("n_chars", size).select(DOCUMENT_COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay whose language is found with a score of at least one half.

    Null texts and texts without letters go. The model is fitted on a bounded sample of the labelled rows.
    """
    short_batches(spark)
    return keep_identified(docs, fit(docs)).select(DOCUMENT_COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat earlier ones, or all but two edits of them, are cut; every document stays.

    Where lines from other documents make up more than a fifth of a document, it may be a copy rather than a
    document with boilerplate, and they wait for document dedup, which cuts them if the document stays.
    """
    return _documents(dedup_lines(docs, copy_share=COPY_SHARE))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that with the smallest doc_id.
    Texts of a repeated doc_id are told apart.

    The repeated lines that the stage before left in likely copies are then cut from those that stay,
    whatever they make up of a document, so no line that repeats one of a document kept is left.
    """
    short_batches(spark)
    gone = saved(near_duplicate_rows(docs).where("not kept").select("id", "k").distinct(), "gone")
    copy = (F.col("doc_id") == F.col("id")) & (F.xxhash64("text") == F.col("k"))
    stay = saved(
        docs.select(DOCUMENT_COLUMNS).join(bounded_broadcast(gone, gone.count()), copy, "left_anti"), "stay"
    )
    return _documents(dedup_lines(stay))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced by a mark; every document stays."""
    short_batches(spark)
    return _documents(redact_secrets(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: one row per piece of a document, with its ids."""
    short_batches(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
    ("secret_scan", secret_scan), ("packing", packing),
]

# token packing has no SQL form: see tests/llm/test_pipeline.py
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
