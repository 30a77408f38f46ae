"""Quotation gate: rules, cross-edition agreement, and rules with a model for the rest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import signals as S
from ..functions import text as T
from . import rerank as RR

# A model scorer adds a probability column `model_prob` for a text column: see `training.scorer`.
Scorer = Callable[[DataFrame, str], DataFrame]


def column_scorer(score: Callable[[Column], Column]) -> Scorer:
    """A scorer from a column expression or an Arrow function."""
    return lambda df, text: df.withColumn("model_prob", score(F.col(text)))


def rule_gate(windows: DataFrame, text: str = "candidate_text") -> DataFrame:
    """Add signals, `rule_score` and `quote_prob` from the candidate sentence only."""
    df = S.with_signals(windows, text)
    return df.withColumn("rule_score", S.rule_score()).withColumn("quote_prob", F.col("rule_score"))


def hybrid_gate(
    windows: DataFrame, scorer: Scorer | None, text: str = "candidate_text"
) -> DataFrame:
    """Rules decide where one fires; only the other rows reach the model.

    A CASE around a Python function would not stop it from running, so the rows are split. With
    no model the rules decide everything.
    """
    df = rule_gate(windows, text)
    if scorer is None:
        return df.withColumn("source", S.signal_source("none"))
    fired = df.filter(S.signal_count() > 0).withColumn("source", S.signal_source())
    rest = df.filter(S.signal_count() == 0)
    rest = scorer(rest, text).withColumn("quote_prob", F.least(F.lit(C.SCORE_CAP), "model_prob"))
    return fired.unionByName(rest.drop("model_prob").withColumn("source", F.lit("model")))


def model_gate(windows: DataFrame, scorer: Scorer, text: str = "candidate_text") -> DataFrame:
    """The model alone decides, whatever the rules say."""
    prob = F.greatest(F.lit(0.0), F.least(F.lit(C.SCORE_CAP), "model_prob"))
    return scorer(windows, text).withColumn("quote_prob", prob).drop("model_prob")


def semantic_gate(
    df: DataFrame, settings: C.Settings = C.Settings(), text: str = "candidate_text"
) -> DataFrame:
    """Rule score raised by agreement of editions; `cands` holds the candidates of each window."""
    return agreement_gate(rule_gate(df, text), settings, text)


def agreement_gate(
    df: DataFrame, settings: C.Settings = C.Settings(), text: str = "candidate_text"
) -> DataFrame:
    """The semantic gate of windows that have their `rule_score` already.

    The mean of a group cannot exceed the best score, so the groups are only formed where the
    best score reaches the threshold.
    """
    cc = settings.concordance
    df = df.withColumns(
        {"top1": F.get(F.col("cands"), 0)["score"], "_nw": T.word_count(F.col(text))}
    )
    df = df.withColumn(
        "best_dual",
        F.when(F.col("top1") >= cc.dual_threshold, RR.best_dual(F.col("cands"), cc.search_k)),
    )
    prob = S.concordance_score(
        F.col("rule_score"), F.col("best_dual"), F.col("top1"), F.col("_nw"), cc
    )
    return df.withColumn("quote_prob", prob).drop("_nw")


def passed(df: DataFrame, threshold: float = C.QUOTE_THRESHOLD) -> DataFrame:
    return df.filter(F.col("quote_prob") >= threshold)


def explain(df: DataFrame, text: str = "candidate_text") -> DataFrame:
    """Why a sentence was classified as it was."""
    source = F.col("source") if "source" in df.columns else S.signal_source()
    return df.select(
        F.col(text).alias("text"), F.col("quote_prob").alias("score"), source.alias("source"),
        F.when(F.col("sig_work"), S.matched_work(F.col(text))).alias("matched_work"),
        S.prediction(F.col("quote_prob")).alias("prediction"),
    )


def asr_quality(
    segments: DataFrame, max_no_speech: float = C.MAX_NO_SPEECH_PROB,
    min_logprob: float = C.MIN_AVG_LOGPROB,
) -> DataFrame:
    """Drop silent, unlikely and blank segments; a missing score passes."""
    return segments.filter(
        (F.coalesce(F.col("no_speech_prob"), F.lit(0.0)) <= max_no_speech)
        & (F.coalesce(F.col("avg_logprob"), F.lit(0.0)) >= min_logprob)
        & (T.clean_trim(F.col("text")) != "")
    )


def min_words(df: DataFrame, text: str, n: int = C.MIN_WORDS) -> DataFrame:
    return df.filter(T.word_count(F.col(text)) >= n)
