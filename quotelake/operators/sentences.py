"""Segments -> sentences -> context windows, and overlap removal between segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .. import config as C
from .. import lexicons as L
from ..functions import text as T
from . import ordered
from .ordered import CHUNK, Axis


def segment_sentences(
    segments: DataFrame, stream: str = "stream_id", seq: str = "seg_id", width: int = 65536
) -> DataFrame:
    """One row per sentence with a dense `sent_id` per stream; times are the segment's.

    Segments stay whole until the last step: the index of a sentence is the running count of
    sentences in earlier segments plus its position in its own segment.
    """
    axis = Axis((stream,), (seq,), width)
    df = segments.withColumn("_sents", T.sentences(F.col("text"))).drop("text")
    df = ordered.running_sum(df, axis, F.size("_sents").cast("long"), "_first")
    keep = [c for c in df.columns if c not in ("_sents", "_first", CHUNK)]
    df = df.select(*keep, "_first", F.posexplode("_sents").alias("pos", "candidate_text"))
    return df.withColumn("sent_id", F.col("_first") + F.col("pos")).drop("_first")


def segment_windows(
    segments: DataFrame, stream: str = "stream_id", seq: str = "seg_id",
    next_words: int = C.NEXT_WORDS, width: int = 65536,
) -> DataFrame:
    """Context windows: previous sentence, sentence, and the next words across sentences.

    Works on segment rows: inside a segment neighbours are array elements; across segments and
    chunks only a segment's last sentence and first words travel.
    """
    axis = Axis((stream,), (seq,), width)
    df = segments.withColumn("_sents", T.sentences(F.col("text"))).drop("text")
    df = axis.cut(df.filter(F.size("_sents") > 0))
    words = F.transform("_sents", T.words)
    df = df.withColumns({"_words": words, "_last": F.element_at("_sents", -1), "_n": F.size("_sents").cast("long")})
    df = df.withColumn("_head", F.slice(F.flatten("_words"), 1, next_words))
    df = _within_chunks(df, axis, next_words)
    df = axis.stitch(df, _between_chunks(df, axis, next_words))
    df = df.withColumns(
        {
            "_first": F.col("_first") + F.coalesce("_before", F.lit(0)),
            "_prev": F.coalesce("_prev", "_last_before"),
            "_ahead": F.slice(F.concat("_near", F.coalesce("_far", F.array().cast("array<string>"))), 1, next_words),
        }
    ).drop("_before", "_last_before", "_near", "_far", "_n")
    tail = F.transform(
        F.sequence(F.lit(0), F.size("_sents") - 1),
        lambda i: F.struct(
            i.alias("pos"),
            F.element_at("_sents", i + 1).alias("candidate_text"),
            F.when(i == 0, F.coalesce("_prev", F.lit("")))
            .otherwise(F.element_at("_sents", F.greatest(i, F.lit(1))))
            .alias("prev_text"),
            F.array_join(
                F.slice(
                    F.concat(
                        F.flatten(
                            F.slice(F.col("_words"), i + 2, F.lit(next_words))
                        ),
                        F.col("_ahead"),
                    ),
                    1,
                    next_words,
                ),
                " ",
            ).alias("next_text"),
        ),
    )
    hidden = {"_sents", "_first", "_words", "_last", "_head", "_prev", "_ahead", CHUNK}
    keep = [c for c in df.columns if c not in hidden]
    df = df.select(*keep, "_first", F.inline(tail))
    df = df.withColumn("sent_id", F.col("_first") + F.col("pos")).drop("_first", "pos")
    return df.withColumn("text", window_text())


def _within_chunks(df: DataFrame, axis: Axis, n: int) -> DataFrame:
    """Sentences before, last sentence before and first `n` words after each segment, in its chunk."""
    earlier = axis.local.rowsBetween(Window.unboundedPreceding, -1)
    # `n` following segments always suffice
    heads = F.collect_list("_head").over(axis.local.rowsBetween(1, n))
    return df.withColumns(
        {
            "_first": F.coalesce(F.sum("_n").over(earlier), F.lit(0)),
            "_prev": F.lag("_last").over(axis.local),
            "_near": F.slice(F.flatten(heads), 1, n),
        }
    )


def _between_chunks(df: DataFrame, axis: Axis, n: int) -> DataFrame:
    """One row per chunk: the same three things from the chunks around it."""
    (order,) = axis.order
    chunks = df.groupBy(*axis.keys, CHUNK).agg(
        F.sum("_n").alias("_total"), F.max_by("_last", order).alias("_end"),
        F.min_by(F.slice(F.concat("_head", "_near"), 1, n), order).alias("_start"),
    )
    earlier = axis.across.rowsBetween(Window.unboundedPreceding, -1)
    starts = F.collect_list("_start").over(axis.across.rowsBetween(1, n))
    return chunks.select(
        *axis.keys, CHUNK, F.sum("_total").over(earlier).alias("_before"),
        F.lag("_end").over(axis.across).alias("_last_before"), F.slice(F.flatten(starts), 1, n).alias("_far"),
    )


def document_sentences(documents: DataFrame, text: str = "text") -> DataFrame:
    """One row per sentence of documents kept in one row each, without window texts.

    With `posexplode` Spark would split all texts twice more to test for documents without sentences.
    """
    df = documents.withColumn("_sents", T.sentences(F.col(text))).drop(text)
    keep = [c for c in df.columns if c != "_sents"]
    df = df.select(*keep, F.posexplode_outer("_sents").alias("sent_id", "candidate_text"))
    return df.filter(F.col("sent_id").isNotNull()).withColumn("sent_id", F.col("sent_id").cast("long"))


def document_windows(
    documents: DataFrame, doc: str = "doc_id", text: str = "text", next_words: int = C.NEXT_WORDS
) -> DataFrame:
    """Windows of documents kept in one row each: array work only, no shuffle at all."""
    df = documents.withColumn("_sents", T.sentences(F.col(text))).drop(text)
    df = df.filter(F.size("_sents") > 0).withColumn("_words", F.transform("_sents", T.words))
    rows = F.transform(
        F.sequence(F.lit(0), F.size("_sents") - 1),
        lambda i: F.struct(
            i.cast("long").alias("sent_id"),
            F.element_at("_sents", i + 1).alias("candidate_text"),
            F.when(i == 0, "").otherwise(
                F.element_at("_sents", F.greatest(i, F.lit(1)))
            ).alias("prev_text"),
            F.array_join(
                F.slice(F.flatten(F.slice("_words", i + 2, F.lit(next_words))), 1, next_words), " "
            ).alias("next_text"),
        ),
    )
    keep = [c for c in df.columns if c not in ("_sents", "_words")]
    return df.select(*keep, F.inline(rows)).withColumn("text", window_text())


def window_text():
    """Non-empty parts of a window joined by a blank."""
    parts = F.array("prev_text", "candidate_text", "next_text")
    return F.array_join(F.filter(parts, lambda p: p != ""), " ")


def word_sentences(
    word_rows: DataFrame, stream: str = "stream_id", seq: str = "word_id", width: int = 65536
) -> DataFrame:
    """Close a sentence at a word ending in . ! ? (optionally quoted); the tail is kept.

    Expects `word`, `start_time`, `end_time`; the span runs from the first to the last word.
    """
    axis = Axis((stream,), (seq,), width)
    ends = F.col("word").rlike(L.WORD_END_PATTERN).cast("long")
    df = ordered.running_sum(word_rows, axis, ends, "sent_id")
    ordered_words = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("p"), F.col("word").alias("w"))))
    return df.groupBy(stream, "sent_id").agg(
        F.array_join(F.transform(ordered_words, lambda s: s["w"]), " ").alias("candidate_text"),
        F.min_by("start_time", seq).alias("start_time"),
        F.max_by("end_time", seq).alias("end_time"),
    )


def boundary_windows(
    rows: DataFrame, stream: str, seq: str, text: str = "text",
    next_words: int = C.NEXT_WORDS, width: int = 65536,
) -> DataFrame:
    """Row windows with blank rows as hard borders; looks ahead into the next row only."""
    axis = Axis((stream,), (seq,), width)
    df = rows.withColumn("_t", F.struct(F.coalesce(F.col(text), F.lit("")).alias("t")))
    df = ordered.carry_last(df, axis, {"_p": F.col("_t")})
    back = Axis((stream,), ("_rev",), width)
    df = df.drop(CHUNK).withColumn("_rev", -F.col(seq))
    df = ordered.carry_last(df, back, {"_n": F.col("_t")})
    df = df.filter(F.col(text) != "").withColumns(
        {
            "candidate_text": F.col(text),
            "prev_text": F.coalesce("_p.t", F.lit("")),
            "next_text": F.array_join(
                F.slice(T.words(F.coalesce("_n.t", F.lit(""))), 1, next_words), " "
            ),
        }
    )
    hidden = ("_t", "_p", "_n", "_rev", CHUNK)
    return df.withColumn("text", window_text()).drop(*hidden)


def overlap_trim_lag(
    segments: DataFrame, stream: str, seq: str, text: str = "text", width: int = 65536
) -> DataFrame:
    """Drop up to ten leading words that repeat the end of the previous raw text.

    Rows of which nothing is left are dropped.
    """
    axis = Axis((stream,), (seq,), width)
    df = ordered.carry_last(segments, axis, {"_prev": F.col(text)}).drop(CHUNK)
    df = df.withColumns(
        {"_pw": T.words(F.coalesce("_prev", F.lit(""))), "_nw": T.words(F.col(text))}
    )
    df = df.withColumn("dropped", T.shared_overlap(F.col("_pw"), F.col("_nw")))
    rest = F.slice("_nw", F.col("dropped") + 1, F.greatest(F.size("_nw"), F.lit(1)))
    trimmed = F.when(F.col("dropped") == 0, F.col(text)).otherwise(F.array_join(rest, " "))
    df = df.withColumn("trimmed", trimmed).drop("_prev", "_pw", "_nw")
    return df.filter(F.trim("trimmed") != "")


def _trim_state(prev: list[str], dropped: int) -> list[str]:
    """Words the next row compares with: the trimmed text, or the whole text if nothing is left."""
    return prev[dropped:] if dropped < len(prev) else prev


def overlap_trim_exact(
    segments: DataFrame, stream: str, seq: str, text: str = "text", width: int = 65536
) -> DataFrame:
    """Overlap removal where the carried text is the trimmed one; rows left empty are dropped.

    The only state is how many words the row before lost (0..10, plus its raw text, which is
    known), so eleven entry states describe a chunk.
    """
    axis = Axis((stream,), (seq,), width)
    df = ordered.carry_last(segments, axis, {"_prev": F.col(text)}).drop(CHUNK)
    limit = C.OVERLAP_WORDS

    def step(rows: ordered.Rows, entry: int) -> list:
        states = []
        lost = entry
        for prev, new in zip(rows["_prev"], rows[text]):
            before = _trim_state(prev.split(), lost) if isinstance(prev, str) else []
            after = new.split()
            top = min(len(before), len(after), limit)
            lost = next((k for k in range(top, 0, -1) if before[-k:] == after[:k]), 0)
            states.append(lost)
        return states

    df = ordered.state_scan(
        df, axis, ordered.folded(list(range(limit + 1)), step), step, "dropped",
        ["_prev", text], 0, IntegerType(),
    )
    nw = T.words(F.col(text))
    rest = F.slice(nw, F.col("dropped") + 1, F.greatest(F.size(nw), F.lit(1)))
    trimmed = F.when(F.col("dropped") == 0, F.col(text)).otherwise(F.array_join(rest, " "))
    return df.withColumn("trimmed", trimmed).drop("_prev", CHUNK).filter(F.trim("trimmed") != "")


def numbered_lines(df: DataFrame, keys: list[str], order: str, out: str = "line_no") -> DataFrame:
    """1-based line numbers per file in file order."""
    axis = Axis(tuple(keys), (order,))
    return ordered.dense_index(df, axis, out).drop(CHUNK).withColumn(out, F.col(out) + 1)
