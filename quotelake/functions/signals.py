"""Rule signals that a sentence quotes or cites a passage, and the scores built on them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from .. import lexicons as L


def _lead(*groups) -> str:
    """Look ahead for the first two signs of some phrase: at most places this rules out all of them."""
    phrases = [p for group in groups for p in group]
    one, two = (
        "".join(sorted({r"\s" if p[i:i + 1] == " " else re.escape(p[i:i + 1]) for p in phrases})) for i in (0, 1)
    )
    return f"(?=[{one}][{two}])" if all(len(p) > 1 for p in phrases) else f"(?=[{one}])"


# the patterns of the lexicon, which a cheap test precedes; none of them matches elsewhere
_ORDINALS = ["1 ", "2 ", "3 ", "1st", "2nd", "3rd", "first", "second", "third"]
_CUE = _lead(L.CUE_PHRASES) + L.CUE_PATTERN
_ATTRIBUTION = r"\b" + _lead(L.SPEAKERS) + L.ATTRIBUTION_PATTERN
_INVERTED = r"\b" + _lead(L.INVERTED_VERBS) + L.INVERTED_PATTERN
_WORK_NAME = r"\b" + _lead(L.BARE_WORK_NAMES, _ORDINALS) + L.WORK_NAME_PATTERN


def _safe(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def cue(text: Column) -> Column:
    return F.lower(_safe(text)).rlike(_CUE)


def cited(text: Column, bare: bool = True) -> Column:
    """A `Work N:N` citation, or (unless disabled) a bare `N:N`."""
    named = _safe(text).rlike(L.NAMED_REF_PATTERN)
    found = named | _safe(text).rlike(L.BARE_REF_PATTERN) if bare else named
    return F.contains(_safe(text), F.lit(":")) & found  # both patterns hold a colon


def attributed(text: Column) -> Column:
    low = F.lower(_safe(text))
    return low.rlike(_ATTRIBUTION) | low.rlike(_INVERTED)


def names_work(text: Column) -> Column:
    return F.lower(_safe(text)).rlike(_WORK_NAME)


def matched_work(text: Column) -> Column:
    """The matched surface form of a work name, or null."""
    return F.nullif(F.regexp_extract(F.lower(_safe(text)), L.WORK_NAME_PATTERN, 0), F.lit(""))


def with_signals(df, text: str, bare_reference: bool = True):
    """Add the four signal flags; scores below read these columns."""
    col = F.col(text)
    return df.withColumns(
        {
            "sig_cue": cue(col),
            "sig_reference": cited(col, bare_reference),
            "sig_attribution": attributed(col),
            "sig_work": names_work(col),
        }
    )


def signal_count() -> Column:
    flags = ["sig_cue", "sig_reference", "sig_attribution", "sig_work"]
    return sum((F.col(f).cast("int") for f in flags[1:]), F.col(flags[0]).cast("int"))


def rule_score() -> Column:
    n = signal_count()
    return F.when(n == 0, F.lit(C.NO_SIGNAL_SCORE)).otherwise(
        F.least(F.lit(C.SCORE_CAP), C.STRONG_SCORE + C.EXTRA_SIGNAL_BONUS * (n - 1))
    )


def signal_source(fallback: str = "none") -> Column:
    return (
        F.when(F.col("sig_cue"), "cue")
        .when(F.col("sig_reference"), "reference")
        .when(F.col("sig_attribution"), "attribution")
        .when(F.col("sig_work"), "book_name")
        .otherwise(fallback)
    )


def prediction(score: Column, threshold: float = C.QUOTE_THRESHOLD) -> Column:
    return F.when(score >= threshold, "scripture").otherwise("not_scripture")


def concordance_score(
    rule: Column, best_dual: Column, top1: Column, n_words: Column,
    cc: C.Concordance = C.Concordance(),
) -> Column:
    """Raise the rule score when two editions of one reference agree, or one match is very close."""
    dual = F.least(
        F.lit(C.SCORE_CAP), cc.dual_base + cc.dual_semantic * best_dual + cc.dual_rule * rule
    )
    single = F.least(
        F.lit(C.SCORE_CAP), cc.top1_base + cc.top1_semantic * top1 + cc.top1_rule * rule
    )
    return (
        F.when((n_words < cc.min_words) | top1.isNull(), rule)
        .when(F.coalesce(best_dual, F.lit(0.0)) >= cc.dual_threshold, F.greatest(rule, dual))
        .when((top1 >= cc.top1_threshold) & (rule >= cc.top1_rule_min), F.greatest(rule, single))
        .otherwise(rule)
    )


def rescued(model_score: Column, rule: Column, threshold: float = C.QUOTE_THRESHOLD) -> Column:
    """Live gate: the model passes, or the rules alone find it plausible."""
    return (model_score >= threshold) | (rule >= C.RESCUE_FLOOR)
