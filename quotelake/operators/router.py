"""Intent routing of utterances: explicit reference, clear, navigation, or quotation search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from .. import lexicons as L
from ..functions import references as R
from ..functions import text as T
from . import lookup

EXPLICIT_REF, CLEAR, NAV, CUE = "EXPLICIT_REF", "CLEAR_COMMAND", "NAV_COMMAND", "CUE_PHRASE"


def _low(text: Column) -> Column:
    return T.clean_trim(F.lower(F.coalesce(text, F.lit(""))))


def is_clear(low: Column) -> Column:
    """A clear phrase inside a lower-cased utterance of at most eight words."""
    return low.rlike(L.either(L.CLEAR_PHRASES)) & (T.word_count(low) <= 8)


def nav_action(low: Column, swap: Column, anchored: Column) -> Column:
    """Item steps win over section steps, forward over backward, swaps come last.

    Without an anchor there is nothing to step from, and a named edition comes first.
    """
    return (
        F.when(~anchored & swap.isNotNull(), "swap_translation")
        .when(low.rlike(L.either(L.NAV_NEXT_ITEM)), "next_verse")
        .when(low.rlike(L.either(L.NAV_PREV_ITEM)), "prev_verse")
        .when(low.rlike(L.either(L.NAV_NEXT_SECTION)), "next_chapter")
        .when(low.rlike(L.either(L.NAV_PREV_SECTION)), "prev_chapter")
        .when(swap.isNotNull(), "swap_translation")
    )


def classify(df: DataFrame, text: str, anchored: Column | None = None) -> DataFrame:
    """Add the parsed reference, `named` edition, `action`, `swap` and `intent` by precedence.

    The broad edition template only counts in utterances of at most six words. `anchored` tells
    rows with an anchor; by default those whose `a_edition` is set.
    """
    if anchored is None:
        anchored = F.col("a_edition").isNotNull() if "a_edition" in df.columns else F.lit(False)
    col = F.col(text)
    df = df.withColumns({**R.spoken_reference(col), "_low": _low(col), "named": R.named_edition(col)})
    short = T.word_count(F.col("_low")) <= 6
    df = df.withColumn(
        "_swap", F.coalesce("named", F.when(short, R.broadly_named_edition(col)))
    )
    df = df.withColumn("_action", nav_action(F.col("_low"), F.col("_swap"), anchored))
    intent = (
        F.when(F.col("ref_item").isNotNull(), EXPLICIT_REF)
        .when(is_clear(F.col("_low")), CLEAR)
        .when(F.col("_action").isNotNull(), NAV)
        .otherwise(CUE)
    )
    df = df.withColumn("intent", intent)
    is_nav = F.col("intent") == NAV
    return df.withColumns(
        {"action": F.when(is_nav, F.col("_action")), "swap": F.when(is_nav, F.col("_swap"))}
    ).drop("_low", "_swap", "_action")


ANCHOR = {"a_edition": "string", "a_work": "string", "a_section": "int", "a_item": "int"}


def route(
    utterances: DataFrame, passages: DataFrame, utt_id: str = "utt_id", text: str = "text",
    default: str = C.DEFAULT_EDITION, broad_edition: bool = False,
) -> DataFrame:
    """Classify and resolve every utterance in one pass over the texts.

    Spoken references and navigation targets become one requested (edition, work, section, item)
    per row, so a single lookup serves both. References fall back to the default edition and then
    to any; steps keep the anchor's edition or take the first by name; a swap must find the asked
    edition. Anchors are optional columns `a_edition, a_work, a_section, a_item` of the row.
    """
    have = set(utterances.columns)
    df = utterances.withColumns(
        {c: F.lit(None).cast(ty) for c, ty in ANCHOR.items() if c not in have}
    )
    df = classify(df, text)
    asked = F.col("named")
    if broad_edition:
        asked = F.coalesce("named", R.broadly_named_edition(F.col(text)))
    explicit, nav = F.col("intent") == EXPLICIT_REF, F.col("intent") == NAV
    df = df.select(
        utt_id, "intent", "action", "swap", "ref_section", "ref_item",
        F.when(explicit, F.col("ref_token")).alias("ref_token"),
        F.when(explicit, F.coalesce(asked, F.lit(default))).otherwise(F.col("a_edition")).alias("_edition"),
        F.when(nav, F.col("a_work")).alias("work"), F.col("a_section").alias("section"),
        F.col("a_item").alias("item"),
    )
    df = R.resolve_works(df, "ref_token", "_spoken")
    df = lookup.step_target(df, passages)
    swap = nav & (F.col("action") == "swap_translation")
    goal = df.select(
        utt_id, "intent", "action", "ref_token",
        F.when(nav, F.col("_edition")).alias("_anchor"),
        F.coalesce(F.when(swap, F.col("swap")), "_edition").alias("edition"),
        F.when(explicit, F.col("_spoken")).otherwise(F.col("work")).alias("work"),
        F.when(explicit, F.col("ref_section")).when(swap, F.col("section"))
        .otherwise(F.col("to_section")).alias("section"),
        F.when(explicit, F.col("ref_item")).when(swap, F.col("item"))
        .otherwise(F.col("to_item")).alias("item"),
    )
    fallback = F.when(F.col("intent") == EXPLICIT_REF, default).otherwise("")
    found = lookup.with_fallback(goal, passages, utt_id, fallback)
    missed_swap = (F.col("action") == "swap_translation") & (F.col("found_edition") != F.col("edition"))
    found = found.withColumn(
        "_hit", F.when(F.coalesce(missed_swap, F.lit(False)), None).otherwise(F.col("found_edition"))
    )
    hit = F.col("_hit").isNotNull()
    reason = (
        F.when(explicit & F.col("work").isNull(), F.concat(F.lit("unknown work: "), "ref_token"))
        .when(explicit & ~hit, "reference out of range")
        .when(nav & F.col("_anchor").isNull(), "no anchor to navigate from")
        .when(swap & ~hit, "edition not available")
        .when(nav & ~hit, "out of range")
    )
    shown = hit | explicit
    return found.select(
        utt_id, "intent", "action",
        F.when(explicit, F.coalesce("_hit", "edition")).otherwise(F.col("_hit")).alias("edition"),
        *[F.when(shown, F.col(c)).alias(c) for c in ("work", "section", "item")],
        F.when(hit, F.col("passage_text")).alias("passage_text"), "available", reason.alias("reason"),
    )
