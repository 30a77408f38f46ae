"""End-to-end detection and search: windows or queries -> candidates -> ranked records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T
from ..functions import vectors as V
from ..operators import detect, knn, live, records, rerank, router, sentences, triage
from ..sources import tables


def candidates(
    queries: DataFrame, passages: DataFrame, keys: list[str], text: str,
    embedder=None, k: int = C.TOP_K,
) -> DataFrame:
    """The queries with `cands`, their k nearest passages. Passages may already carry `vec`."""
    embedder = embedder or V.BowEmbedder()
    corpus = passages if "vec" in passages.columns else passages.withColumn(
        "vec", V.embed_column(embedder, F.col("text"), False)
    )
    carry = [c for c in queries.columns if c not in keys]
    return knn.knn_lists(
        queries, corpus.select("passage_id", "vec", *rerank.META), keys, "passage_id",
        query_vec=text, k=k, carry=carry, meta=rerank.META, dim=embedder.dim, encode=embedder.encode,
    )


def retrieve(
    queries: DataFrame, passages: DataFrame, keys: list[str], text: str,
    embedder=None, k: int = C.TOP_K,
) -> DataFrame:
    """Query keys, rank, score and passage_id as rows."""
    found = candidates(queries.select(*keys, text), passages, keys, text, embedder, k)
    return found.select(*keys, F.inline("cands")).drop(*rerank.META)


def detect_windows(
    windows: DataFrame, passages: DataFrame, keys: list[str],
    detector: str = "semantic", settings: C.Settings = C.Settings(),
    embedder=None, scorer: detect.Scorer | None = None,
) -> DataFrame:
    """Result records of context windows.

    `rules`, `hybrid` and `model` gate before retrieval, so only passed windows are searched; the
    `semantic` gate needs the candidates and reuses them for ranking; its rule score is computed before
    retrieval, as a filter on it would be pushed down and search every sentence for each mention of a
    signal. With a corpus that a task can hold nothing is shuffled before the gate.
    """
    text = "candidate_text"
    if detector == "semantic":
        k = max(settings.top_k, settings.concordance.search_k)
        ruled = detect.rule_gate(windows, text).select(*dict.fromkeys([*windows.columns, "rule_score"]))
        found = candidates(ruled, passages, keys, text, embedder, k)
        gated = detect.passed(detect.agreement_gate(found, settings, text), settings.quote_threshold)
        gated = gated.withColumn("cands", F.slice("cands", 1, settings.top_k))
    else:
        if detector == "rules":
            scored = detect.rule_gate(windows)
        elif detector == "hybrid":
            scored = detect.hybrid_gate(windows, scorer)
        elif detector == "model":
            scored = detect.model_gate(windows, scorer)
        else:
            raise ValueError(f"unknown detector: {detector}")
        gated = detect.passed(scored, settings.quote_threshold)
        gated = candidates(gated, passages, keys, text, embedder, settings.top_k)
    ranked = rerank.rerank(gated, passages, text, keys, settings)
    return records.surfaced(records.build_records(ranked, keys, settings), settings.include_ignored)


def detect_segments(segments: DataFrame, passages: DataFrame, **kw) -> DataFrame:
    """Transcript segments -> result records."""
    windows = sentences.segment_windows(segments)
    return detect_windows(windows, passages, ["stream_id", "sent_id"], **kw)


def search(
    queries: DataFrame, passages: DataFrame, query_id: str = "query_id", text: str = "query",
    k: int = C.TOP_K, edition: str | None = None, prefilter: bool = False, ranked: bool = True,
    settings: C.Settings = C.Settings(), embedder=None,
) -> DataFrame:
    """Many text searches at once: one row per result with its scores.

    An edition filter over-fetches 2k and may return fewer than k; `prefilter` searches that
    edition alone instead.
    """
    k = C.checked_top_k(k)
    edition = edition.upper() if edition else None
    pool = passages.filter(F.upper("edition") == edition) if edition and prefilter else passages
    fetch = 2 * k if edition and not prefilter else k
    df = candidates(queries, pool, [query_id], text, embedder, fetch)
    if edition:
        df = df.withColumn(
            "cands", F.slice(F.filter("cands", lambda c: F.upper(c["edition"]) == edition), 1, k)
        )
    if not ranked:
        df = df.select(query_id, F.posexplode("cands").alias("pos", "c"))
        df = df.select(
            query_id, (F.col("pos") + 1).alias("rank"), "c.edition", "c.work", "c.section", "c.item",
            "c.passage_id", "c.score",
        )
        return df.join(passages.select("passage_id", "text"), "passage_id").drop("passage_id")
    df = df.withColumn("quote_prob", F.lit(0.90))
    df = rerank.rerank(df, passages, text, [query_id], settings)
    df = df.select(query_id, F.posexplode(F.slice("ranked", 1, k)).alias("pos", "c"))
    return df.select(
        query_id, (F.col("pos") + 1).alias("rank"), "c.edition", "c.work", "c.section", "c.item",
        "c.text", F.col("c.final").alias("score"), "c.semantic", "c.lexical",
    )


def triage_rows(
    rows: DataFrame, passages: DataFrame, file: str = "file", settings: C.Settings = C.Settings(),
    embedder=None,
) -> DataFrame:
    """Suggestions for every non-blank row; ranking runs whatever the gate says."""
    windows = sentences.boundary_windows(rows, file, "line")
    keys = [file, "line"]
    found = candidates(windows, passages, keys, "candidate_text", embedder, settings.top_k)
    scored = detect.semantic_gate(found, settings)
    scored = scored.withColumns({"start_time": F.col("line") * 1.0, "end_time": F.col("line") * 1.0})
    ranked = rerank.rerank(scored, passages, "candidate_text", keys, settings)
    found = triage.suggestions(records.build_records(ranked, keys, settings))
    fields = ["suggested_label", "suggested_verse", "confidence", "confidence_band",
              "quote_probability", "top_candidate"]
    df = rows.filter(F.coalesce("text", F.lit("")) != "").join(
        found.select(*keys, *fields), keys, "left"
    )
    defaults = {"suggested_label": "negative", "suggested_verse": "0", "confidence_band": C.BAND_IGNORED}
    return df.fillna(defaults)


def triage_csv(
    spark: SparkSession, path: str, passages: DataFrame, out: str, settings: C.Settings = C.Settings(),
    embedder=None,
) -> DataFrame:
    """Triage a ragged CSV into a review sheet at `out`; the outcomes of the gold rows come back.

    The sheet has the twelve review columns, gold rows first, then by band and confidence: its part files
    in name order hold that order, so no task sorts more than its range.
    """
    rows = tables.read_ragged_csv(spark, path)
    gold, todo, _ = triage.split_rows(rows)
    triaged = triage_rows(rows, passages, settings=settings, embedder=embedder)
    tables.write_csv(triage.review_sheet(gold, triaged.join(todo.select("file", "line"), ["file", "line"], "left_semi")), out)
    checked = triaged.join(gold.select("file", "line"), ["file", "line"], "left_semi")
    return triage.outcome_counts(checked, "label", "suggested_label")


def detect_utterances(
    utterances: DataFrame, passages: DataFrame, key: str = "utt_id", text: str = "text",
    settings: C.Settings = C.Settings(), embedder=None,
) -> DataFrame:
    """Live detection of complete quotation texts: gate, query variants, best variant, agreement.

    A detection carries the reference, edition and text of the passage, so it can be presented.
    """
    gated = detect.rule_gate(utterances.withColumn("candidate_text", F.col(text)))
    gated = gated.filter(F.col("quote_prob") >= settings.quote_threshold)
    gated = detect.min_words(gated, "candidate_text")
    variants = gated.select(
        key, "candidate_text", F.posexplode(T.query_variants(F.col("candidate_text"))).alias("variant_no", "variant")
    )
    keys = [key, "variant_no"]
    found = candidates(variants, passages, keys, "variant", embedder, settings.top_k)
    ranked = rerank.rerank(found, passages, "candidate_text", keys, settings)
    best = F.get(F.col("ranked"), 0)
    per_variant = ranked.select(
        key, "variant_no", best["final"].alias("confidence"),
        T.reference(best["work"], best["section"], best["item"]).alias("reference"),
        best["edition"].alias("edition"), best["text"].alias("passage_text"),
    )
    voted = live.live_floor(live.vote(per_variant, [key], ("edition", "passage_text")))
    return voted.withColumn("confidence_band", T.band(F.col("confidence")))


def route_and_detect(
    utterances: DataFrame, passages: DataFrame, utt_id: str = "utt_id", text: str = "text", **kw
) -> tuple[DataFrame, DataFrame]:
    """(routed commands, detections): commands never reach the search."""
    routed = router.route(utterances, passages, utt_id, text)
    cues = routed.filter(F.col("intent") == router.CUE).select(utt_id)
    detected = detect_utterances(utterances.join(cues, utt_id, "left_semi"), passages, utt_id, text, **kw)
    return routed.filter(F.col("intent") != router.CUE), detected
