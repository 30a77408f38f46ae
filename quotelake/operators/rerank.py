"""Re-ranking of retrieved passages: semantic and lexical blend, optional pair scorer.

Candidates of a query are at most k and travel as one array per query; only queries that passed
the gate are unfolded to rows, scored and folded back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T

# fields a candidate carries from the passage table; texts are joined for ranking only
META = ["edition", "work", "section", "item"]


def with_keywords(passages: DataFrame) -> DataFrame:
    """Passage texts with their keyword set, computed once per passage rather than per candidate."""
    return passages.select("passage_id", "text", T.keyword_set(F.col("text")).alias("keywords"))


def best_dual(cands: Column, k: int) -> Column:
    """Best mean score of a reference that shows up in two or more editions among the first k."""
    top = F.slice(cands, 1, k)

    def same(a, b):
        return (a["work"] == b["work"]) & (a["section"] == b["section"]) & (a["item"] == b["item"])

    def mean_if_dual(c):
        group = F.filter(top, lambda o: same(o, c))
        total = F.aggregate(group, F.lit(0.0), lambda acc, o: acc + o["score"])
        return F.when(
            F.exists(group, lambda o: o["edition"] != c["edition"]), total / F.size(group)
        )

    return F.array_max(F.transform(top, mean_if_dual))


def final_score(
    semantic: Column, lexical: Column, weights: C.RerankWeights,
    context: Column | None = None, history: Column | None = None, quote_prob: Column | None = None,
) -> Column:
    """Weighted sum clamped to [0, 1]; terms of zero weight are left out of the plan."""
    total = weights.semantic * semantic + weights.lexical * lexical
    for weight, term in (
        (weights.context, context), (weights.history, history), (weights.quote_prob, quote_prob),
    ):
        if weight:
            if term is None:
                raise ValueError("a weighted signal needs its column")
            total = total + weight * term
    return T.clamp01(total)


def _regroup(rows: DataFrame, keys: list[str], carried: list[str], body: Column, out: str) -> DataFrame:
    """Back to one row per query; a group holds at most k candidates."""
    return rows.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in carried], F.array_sort(F.collect_list(body)).alias(out)
    )


def rerank(
    df: DataFrame, passages: DataFrame, query_text: str, keys: list[str],
    settings: C.Settings = C.Settings(), out: str = "ranked",
) -> DataFrame:
    """Replace `cands` by `out`: candidates with text, semantic, lexical and final score, best first.

    Ties keep the retrieval order. Scores are plain columns of candidate rows, so each is
    computed once inside generated code.
    """
    carried = [c for c in df.columns if c not in (*keys, "cands")]
    low = F.lower(F.coalesce(F.col(query_text), F.lit("")))
    rows = df.withColumns(
        {"_qset": T.keyword_set(F.col(query_text)), "_low": low, "_squeezed": T.without_blanks(low)}
    )
    fields = ["rank", "score", "passage_id", *[f"_{m}" for m in META]]
    rows = rows.select(
        *keys, *carried, "_qset", "_low", "_squeezed", F.inline("cands").alias(*fields)
    )
    texts = with_keywords(passages).select(
        "passage_id", F.col("text").alias("_text"), F.col("keywords").alias("_keywords")
    )
    rows = rows.join(texts, "passage_id").withColumns(
        {
            "_shared": F.size(F.array_intersect("_qset", "_keywords")),
            "_semantic": T.clamp01(F.col("score")),
        }
    )
    lexical = T.lexical_score(
        F.col("_shared"), F.size("_qset"), F.size("_keywords"), F.col("_low"), F.col("_squeezed"),
        F.col("_work"), F.col("_section"), F.col("_item"),
    )
    rows = rows.withColumn("_lexical", lexical)
    prob = F.col("quote_prob") if "quote_prob" in carried else None
    rows = rows.withColumn(
        "_final", final_score(F.col("_semantic"), F.col("_lexical"), settings.weights, quote_prob=prob)
    )
    body = F.struct(
        (-F.col("_final")).alias("order"), "rank", F.col("_final").alias("final"),
        F.col("_semantic").alias("semantic"), F.col("_lexical").alias("lexical"),
        "passage_id", *[F.col(f"_{m}").alias(m) for m in (*META, "text")],
    )
    return _regroup(rows, keys, carried, body, out)


def blend_pair_scores(
    df: DataFrame, keys: list[str], pair_score, settings: C.Settings = C.Settings(),
    ranked: str = "ranked",
) -> DataFrame:
    """Blend a pair scorer into the first N candidates and sort again.

    `pair_score` maps a row with the candidate fields to a raw score column (an expression or an
    Arrow function of query and passage text). Raw scores pass a sigmoid and are min-max scaled
    inside the group (0.5 if they are flat).
    """
    n, w = settings.pair_scorer_topn, settings.pair_scorer_weight
    carried = [c for c in df.columns if c not in (*keys, ranked)]
    rows = df.select(*keys, *carried, F.posexplode(ranked).alias("_pos", "_c"))
    scored = F.when(F.col("_pos") < n, T.sigmoid(pair_score(F.col("_c"))))
    rows = rows.withColumn("_sig", scored)
    group = Window.partitionBy(*keys)
    rows = rows.withColumns({"_lo": F.min("_sig").over(group), "_hi": F.max("_sig").over(group)})
    flat = F.col("_hi") - F.col("_lo") < 1e-6
    scaled = F.when(flat, F.lit(0.5)).otherwise(
        (F.col("_sig") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    )
    blended = T.clamp01((1.0 - w) * F.col("_c.final") + w * scaled)
    rows = rows.withColumn(
        "_final", F.when(F.col("_pos") < n, blended).otherwise(F.col("_c.final"))
    )
    fields = ["semantic", "lexical", "passage_id", *META, "text"]
    body = F.struct(
        (-F.col("_final")).alias("order"), (F.col("_pos") + 1).alias("rank"),
        F.col("_final").alias("final"), *[F.col(f"_c.{f}").alias(f) for f in fields],
    )
    return _regroup(rows, keys, carried, body, ranked)


def history_score(candidates: DataFrame, accepted: DataFrame, stream: str, seq: str) -> DataFrame:
    """1.0 if the reference was accepted earlier in the stream, 0.5 if only its work was.

    "Earlier" needs only the first acceptance per reference and per work, so two aggregates and
    equi-joins replace an ordered scan.
    """
    by_ref = accepted.groupBy(stream, "reference").agg(F.min(seq).alias("_first_ref"))
    by_work = accepted.groupBy(stream, "work").agg(F.min(seq).alias("_first_work"))
    df = candidates.join(by_ref, [stream, "reference"], "left").join(by_work, [stream, "work"], "left")
    score = (
        F.when(F.col("_first_ref") < F.col(seq), 1.0)
        .when(F.col("_first_work") < F.col(seq), 0.5)
        .otherwise(0.0)
    )
    return df.withColumn("history", score).drop("_first_ref", "_first_work")


def context_score(
    candidates: DataFrame, accepted: DataFrame, stream: str, seq: str, cand_id: str,
    work_weight: float = 0.5, keyword_weight: float = 0.5,
) -> DataFrame:
    """How well a candidate fits the works and keywords accepted earlier in the stream.

    `accepted` holds (stream, seq, work, keywords). Counts of earlier acceptances come from one
    sorted count list per (stream, work); keywords need only their first acceptance.
    """
    from . import ordered
    from .ordered import Axis

    axis = Axis((stream,), (seq,))
    marks = accepted.groupBy(stream, seq).agg(F.count("*").alias("_n"))
    points = candidates.select(stream, seq).distinct()
    timeline = points.join(marks, [stream, seq], "full").withColumn("_n", F.coalesce("_n", F.lit(0)))
    totals = ordered.running_sum(timeline, axis, F.col("_n"), "_total").select(stream, seq, "_total")

    work_axis = Axis((stream, "work"), (seq,))
    work_marks = accepted.groupBy(stream, "work", seq).agg(F.count("*").alias("_n"))
    work_points = candidates.select(stream, "work", seq).distinct()
    work_line = work_points.join(work_marks, [stream, "work", seq], "full")
    work_line = work_line.withColumn("_n", F.coalesce("_n", F.lit(0)))
    per_work = ordered.running_sum(work_line, work_axis, F.col("_n"), "_of_work")
    per_work = per_work.select(stream, "work", seq, "_of_work")

    first_seen = (
        accepted.select(stream, seq, F.explode(F.array_distinct("keywords")).alias("_kw"))
        .groupBy(stream, "_kw").agg(F.min(seq).alias("_kw_seq"))
    )
    known = (
        candidates.select(stream, seq, cand_id, F.explode("keywords").alias("_kw"))
        .join(first_seen, [stream, "_kw"], "left")
        .groupBy(stream, seq, cand_id)
        .agg(F.avg((F.coalesce("_kw_seq", F.col(seq)) < F.col(seq)).cast("double")).alias("_kw_share"))
    )
    df = (
        candidates.join(totals, [stream, seq], "left")
        .join(per_work, [stream, "work", seq], "left")
        .join(known, [stream, seq, cand_id], "left")
    )
    share = F.col("_of_work") / F.greatest("_total", F.lit(1))
    work_signal = F.when(F.col("_of_work") > 0, F.greatest(share, F.lit(0.5))).otherwise(0.0)
    value = work_weight * work_signal + keyword_weight * F.coalesce("_kw_share", F.lit(0.0))
    return df.withColumn("context", value).drop("_total", "_of_work", "_kw_share")
