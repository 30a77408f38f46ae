"""Vectors, nearest passages, re-ranking, detection records and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from .. import lexicons as L
from ..functions import vectors as V
from ..operators import detect, knn, live, records, rerank, sentences as SE
from ..plans import detection as D
from . import bindings as B
from .bindings import query
from .text_queries import _FLAGS

R4 = B.sql_round


# ---- dense vectors: every vector is a query and a corpus row -----------------------------------
def _vectors(spark, sf):
    return B.table(spark, sf, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("vec")
    )


def _knn(spark, sf, k):
    v = _vectors(spark, sf)
    corpus = v.select(F.col("vec_id").alias("cand_id"), "vec")
    return knn.knn_topk(v, corpus, ["vec_id"], "cand_id", k=k)


_DENSE = """
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT a.vec_id, b.vec_id AS cand_id, b.label, round(list_dot_product(a.e, b.e) * 1e6) / 1e6 AS score FROM v a CROSS JOIN v b),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, cand_id)::INTEGER AS rank FROM s)"""


@query("""
SELECT vec_id, pos, floor(x / norm * 1e6 + 0.5::DOUBLE) / 1e6 AS value FROM (
  SELECT vec_id, norm, unnest(range(0, len(e)))::INTEGER AS pos, unnest(e) AS x FROM (
    SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings))
""")
def l2_normalise(spark, sf):
    unit = V.l2_normalise(F.col("embedding"))
    df = B.table(spark, sf, "embeddings").select("vec_id", F.posexplode(unit).alias("pos", "x"))
    return df.select("vec_id", "pos", records.round_at(F.col("x"), 6).alias("value"))


@query(f"WITH {_DENSE} SELECT vec_id, cand_id, score, rank FROM ranked WHERE rank <= 10")
def knn_top10(spark, sf):
    return _knn(spark, sf, 10)


@query(f"""
WITH {_DENSE}, kept AS (SELECT * FROM ranked WHERE rank <= 20 AND cand_id % 2 = 1)
SELECT vec_id, cand_id, score, row_number() OVER (PARTITION BY vec_id ORDER BY rank)::INTEGER AS rank
FROM kept QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY rank) <= 10
""")
def knn_edition_filter(spark, sf):
    hits = _knn(spark, sf, 20).withColumn("edition", (F.col("cand_id") % 2).cast("string"))
    return knn.filter_edition(hits, ["vec_id"], "1", 10).drop("edition")


def _dense_candidates(spark, sf, k):
    """Labels act as references and the parity of the id as edition."""
    v = _vectors(spark, sf)
    corpus = v.select(
        F.col("vec_id").alias("passage_id"), (F.col("vec_id") % 2).cast("string").alias("edition"),
        F.col("label").cast("string").alias("work"), F.lit(1).alias("section"), F.lit(1).alias("item"), "vec",
    )
    return knn.knn_lists(v, corpus, ["vec_id"], "passage_id", k=k, meta=rerank.META)


_DUAL = """
g AS (SELECT vec_id, label, count(DISTINCT cand_id % 2) AS ne, sum(score) / count(*) AS m FROM ranked WHERE rank <= 5 GROUP BY ALL),
top1 AS (SELECT vec_id, score AS top1 FROM ranked WHERE rank = 1),
dual AS (SELECT top1.vec_id, top1.top1, max(m) FILTER (ne >= 2) AS best_dual FROM top1 LEFT JOIN g USING (vec_id) GROUP BY ALL)"""


@query(f"WITH {_DENSE}, {_DUAL} SELECT vec_id, {R4('best_dual', 5)} AS best_dual, top1 FROM dual")
def concordance(spark, sf):
    df = _dense_candidates(spark, sf, 5)
    return df.select(
        "vec_id", records.round_at(rerank.best_dual(F.col("cands"), 5), 5).alias("best_dual"),
        F.get("cands", 0)["score"].alias("top1"),
    )


@query(f"""
WITH {_DENSE}, {_DUAL},
r AS (SELECT d.*, CASE WHEN vec_id % 3 = 0 THEN 0.92::DOUBLE ELSE 0.05::DOUBLE END AS h, vec_id % 5 AS nw FROM dual d)
SELECT vec_id, {R4('''CASE WHEN nw < 3 THEN h
  WHEN coalesce(best_dual, 0) >= 0.70 THEN greatest(h, least(0.99::DOUBLE, 0.40::DOUBLE + 0.50::DOUBLE * best_dual + 0.10::DOUBLE * h))
  WHEN top1 >= 0.80 AND h >= 0.25 THEN greatest(h, least(0.99::DOUBLE, 0.50::DOUBLE + 0.30::DOUBLE * top1 + 0.20::DOUBLE * h)) ELSE h END''', 5)} AS score
FROM r
""")
def concordance_boost(spark, sf):
    from ..functions import signals as S

    df = _dense_candidates(spark, sf, 5)
    rule = F.when(F.col("vec_id") % 3 == 0, 0.92).otherwise(0.05)
    score = S.concordance_score(
        rule, rerank.best_dual(F.col("cands"), 5), F.get("cands", 0)["score"], F.col("vec_id") % 5
    )
    return df.select("vec_id", records.round_at(score, 5).alias("score"))


# ---- text retrieval with the hashed bag of words --------------------------------------------------
_P_BOW = B.bow_ctes("p", "passages", "passage_id", "text", False)


def _hits(keys: str, k: int, source: str) -> str:
    """The k best passages of every row of the source; pairs without a common word score 0."""
    return f"""
met AS (SELECT {keys}, passage_id, round(sum(q_bow.w * p_bow.w) * 1e6) / 1e6 AS score
  FROM q_bow JOIN p_bow USING (dim) GROUP BY {keys}, passage_id),
sc AS (SELECT {keys}, passage_id, coalesce(score, 0) AS score
  FROM (SELECT {keys} FROM {source}) CROSS JOIN (SELECT passage_id FROM passages) LEFT JOIN met USING ({keys}, passage_id)),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, passage_id)::INTEGER AS rank FROM sc) WHERE rank <= {k})"""


def _lex(q: str, p: str) -> str:
    qs, ps = f"list_distinct({B.sql_tokens(q, L.KEYWORD_STOP)})", f"list_distinct({B.sql_tokens(p, L.KEYWORD_STOP)})"
    return qs, ps


_LEX_COLS = f"""
  CASE WHEN len(qs) + len(ps) - inter = 0 THEN 0::DOUBLE ELSE inter::DOUBLE / (len(qs) + len(ps) - inter) END AS jac,
  CASE WHEN least(len(qs), len(ps)) = 0 THEN 0::DOUBLE ELSE inter::DOUBLE / least(len(qs), len(ps)) END AS ovl,
  CASE WHEN contains(lower(qtext), lower(work)) THEN 0.10::DOUBLE ELSE 0::DOUBLE END AS named,
  CASE WHEN contains(regexp_replace(lower(qtext), '\\s', '', 'g'), section || ':' || item) THEN 0.10::DOUBLE ELSE 0::DOUBLE END AS located"""


def _ranked(keys: str, source: str, qtext: str) -> str:
    qs, ps = _lex("s." + qtext, "p.text")
    return f"""
pq AS (SELECT {keys}, {qtext} AS qtext, list_distinct({B.sql_tokens(qtext, L.KEYWORD_STOP)}) AS qs FROM {source}),
pp AS (SELECT passage_id, edition, work, section, item, list_distinct({B.sql_tokens('text', L.KEYWORD_STOP)}) AS ps FROM passages),
l0 AS (SELECT *, len(list_intersect(qs, ps)) AS inter FROM hits JOIN pq USING ({keys}) JOIN pp USING (passage_id)),
l1 AS (SELECT *, {_LEX_COLS} FROM l0),
l2 AS (SELECT *, least(1::DOUBLE, greatest(0::DOUBLE, score)) AS semantic,
  greatest(0::DOUBLE, least(1::DOUBLE, 0.5::DOUBLE * jac + 0.5::DOUBLE * ovl + named + located)) AS lexical FROM l1),
l3 AS (SELECT *, greatest(0::DOUBLE, least(1::DOUBLE, 0.8::DOUBLE * semantic + 0.2::DOUBLE * lexical)) AS final FROM l2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY final DESC, rank)::INTEGER AS pos FROM l3)"""


@query(f"""
WITH {B.PASSAGES}, {_P_BOW}, q0 AS (SELECT passage_id AS query_id, text FROM passages),
{B.bow_ctes("q", "q0", "query_id", "text", True)},
a AS (SELECT q0.query_id, passages.passage_id FROM q0 CROSS JOIN passages),
sc AS (SELECT a.query_id, a.passage_id, coalesce(round(sum(q_bow.w * p_bow.w) * 1e6) / 1e6, 0) AS score
  FROM a LEFT JOIN q_bow USING (query_id) LEFT JOIN p_bow ON p_bow.passage_id = a.passage_id AND p_bow.dim = q_bow.dim GROUP BY ALL)
SELECT query_id, passage_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id)::INTEGER AS rank
FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) <= 5
""")
def bow_cosine_top5(spark, sf):
    p = B.passages(spark, sf)
    queries = p.select(F.col("passage_id").alias("query_id"), "text")
    return D.retrieve(queries, p, ["query_id"], "text", k=5)


_TURNS = "turns AS (SELECT conv_id * 100 + turn AS query_id, text AS query FROM conversations)"
_SEARCH = f"""{B.PASSAGES}, {_P_BOW}, {_TURNS}, {B.bow_ctes("q", "turns", "query_id", "query", True)},"""


def _turns(spark, sf):
    return B.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.col("text").alias("query")
    )


@query(f"""
WITH {_SEARCH} {_hits("query_id", 10, "turns")}, {_ranked("query_id", "turns", "query")}
SELECT query_id, pos AS rank, edition, work, section, item, {R4("final", 4)} AS score, {R4("semantic", 4)} AS semantic, {R4("lexical", 4)} AS lexical
FROM ranked
""")
def search_reranked(spark, sf):
    df = D.search(_turns(spark, sf), B.passages(spark, sf), settings=C.Settings())
    return df.select(
        "query_id", "rank", "edition", "work", "section", "item",
        *[records.round_at(F.col(c), 4).alias(c) for c in ("score", "semantic", "lexical")],
    )


@query(f"""
WITH {_SEARCH} {_hits("query_id", 10, "turns")}
SELECT query_id, edition, work, section, item, score, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INTEGER AS rank
FROM hits JOIN passages USING (passage_id) WHERE edition = 'NKJV'
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 5
""")
def search_edition(spark, sf):
    df = D.search(_turns(spark, sf), B.passages(spark, sf), k=5, edition="NKJV", ranked=False)
    return df.select("query_id", "rank", "edition", "work", "section", "item", "score")


def _sig(x: str) -> str:
    return f"CASE WHEN {x} >= 0 THEN 1 / (1 + exp(-({x}))) ELSE exp({x}) / (1 + exp({x})) END"


@query(f"""
WITH {_SEARCH} {_hits("query_id", 10, "turns")}, {_ranked("query_id", "turns", "query")},
raw AS (SELECT *, 10::DOUBLE * lexical - 2::DOUBLE AS raw FROM ranked),
sg AS (SELECT *, {_sig("raw")} AS sig FROM raw),
mm AS (SELECT *, min(sig) OVER w AS lo, max(sig) OVER w AS hi FROM sg WINDOW w AS (PARTITION BY query_id)),
ce AS (SELECT *, CASE WHEN hi - lo < 1e-6 THEN 0.5::DOUBLE ELSE (sig - lo) / (hi - lo) END AS scaled FROM mm),
bl AS (SELECT *, greatest(0::DOUBLE, least(1::DOUBLE, 0.7::DOUBLE * final + 0.3::DOUBLE * scaled)) AS blended FROM ce)
SELECT query_id, edition, work, section, item, floor(blended * 1e4 + 0.5::DOUBLE) / 1e4 AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY round(blended, 9) DESC, pos)::INTEGER AS rank FROM bl
""")
def pair_score_blend(spark, sf):
    queries = _turns(spark, sf)
    found = D.candidates(queries, B.passages(spark, sf), ["query_id"], "query")
    df = rerank.rerank(found, B.passages(spark, sf), "query", ["query_id"])
    df = rerank.blend_pair_scores(df, ["query_id"], lambda c: 10.0 * c["lexical"] - 2.0)
    df = df.select("query_id", F.posexplode("ranked").alias("pos", "c"))
    return df.select(
        "query_id", (F.col("pos") + 1).alias("rank"), "c.edition", "c.work", "c.section", "c.item",
        records.round_at(F.col("c.final"), 4).alias("score"),
    )


# ---- detection over whole documents -------------------------------------------------------------
_DOC_SENTS = f"""
ds AS (SELECT doc_id, {B.sql_sentences('text')} AS ss FROM documents),
dw AS (SELECT doc_id, (i - 1)::BIGINT AS sent_id, ss[i] AS candidate_text FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM ds))"""
_DETECT = f"""{B.PASSAGES}, {_P_BOW}, {_DOC_SENTS}, {B.bow_ctes("q", "dw", "doc_id, sent_id", "candidate_text", True)},
{_hits("doc_id, sent_id", 10, "dw")},
cue_segments AS (SELECT doc_id, sent_id, candidate_text AS text FROM dw),
{_FLAGS},
hp AS (SELECT * FROM hits JOIN passages USING (passage_id)),
gg AS (SELECT doc_id, sent_id, work, section, item, count(DISTINCT edition) AS ne, sum(score) / count(*) AS m FROM hp WHERE rank <= 5 GROUP BY ALL),
du AS (SELECT doc_id, sent_id, max(m) FILTER (ne >= 2) AS best_dual FROM gg GROUP BY ALL),
t1 AS (SELECT doc_id, sent_id, score AS top1 FROM hits WHERE rank = 1),
gate AS (SELECT r.doc_id, r.sent_id, r.text AS candidate_text, rule_score AS h, best_dual, coalesce(top1, 0) AS top1,
   len({B.sql_words('r.text')}) AS nw FROM rules r LEFT JOIN du USING (doc_id, sent_id) LEFT JOIN t1 USING (doc_id, sent_id)),
prob AS (SELECT *, CASE WHEN nw < 3 THEN h
  WHEN coalesce(best_dual, 0) >= 0.70 THEN greatest(h, least(0.99::DOUBLE, 0.40::DOUBLE + 0.50::DOUBLE * best_dual + 0.10::DOUBLE * h))
  WHEN top1 >= 0.80 AND h >= 0.25 THEN greatest(h, least(0.99::DOUBLE, 0.50::DOUBLE + 0.30::DOUBLE * top1 + 0.20::DOUBLE * h)) ELSE h END AS quote_prob FROM gate),
passed AS (SELECT * FROM prob WHERE quote_prob >= 0.40),
{_ranked("doc_id, sent_id", "passed", "candidate_text")},
best AS (SELECT doc_id, sent_id, work, section, item, edition, final FROM ranked WHERE pos = 1),
records AS (SELECT doc_id, sent_id, candidate_text AS transcript, {R4("quote_prob", 4)} AS quote_probability,
  work || ' ' || section || ':' || item AS selected_reference, edition, {R4("final", 4)} AS confidence,
  CASE WHEN final >= 0.60 THEN 'autopilot-eligible' ELSE 'review queue' END AS confidence_band
  FROM passed JOIN best USING (doc_id, sent_id) WHERE final >= 0.40)"""


def _detected(spark, sf, **kw):
    docs = B.table(spark, sf, "documents").select("doc_id", "text")
    windows = SE.document_sentences(docs).withColumns(
        {"start_time": F.col("sent_id") * 1.0, "end_time": F.col("sent_id") + 1.0}
    )
    return D.detect_windows(windows, B.passages(spark, sf), ["doc_id", "sent_id"], **kw)


@query(f"WITH {_DETECT} SELECT * FROM records")
def detection_records(spark, sf):
    """Flagship: sentences of all documents that quote a passage."""
    return _detected(spark, sf).drop("start_time", "end_time", "candidates")


@query(f"""
WITH {_DETECT}
SELECT doc_id, sent_id, pos, r.work || ' ' || r.section || ':' || r.item AS reference, r.edition, {R4("final", 4)} AS score
FROM ranked r SEMI JOIN records USING (doc_id, sent_id)
""")
def top_candidates(spark, sf):
    df = _detected(spark, sf).select("doc_id", "sent_id", F.posexplode("candidates").alias("pos", "c"))
    return df.select(
        "doc_id", "sent_id", (F.col("pos") + 1).alias("pos"), "c.reference", "c.edition", "c.score"
    )


@query(f"""
WITH {B.PASSAGES}, {_P_BOW}, {B.CUE_SEGMENTS}, {_FLAGS},
passed AS (SELECT stream_id, seg_id, text AS candidate_text, rule_score FROM rules WHERE rule_score >= 0.40),
{B.bow_ctes("q", "passed", "stream_id, seg_id", "candidate_text", True)}, {_hits("stream_id, seg_id", 10, "passed")},
{_ranked("stream_id, seg_id", "passed", "candidate_text")}
SELECT stream_id, seg_id, work || ' ' || section || ':' || item AS selected_reference, edition, {R4("final", 4)} AS confidence
FROM ranked WHERE pos = 1
""")
def rules_detection(spark, sf):
    windows = B.cue_segments(spark, sf).withColumnRenamed("text", "candidate_text")
    df = D.detect_windows(
        windows, B.passages(spark, sf), ["stream_id", "seg_id"], detector="rules",
        settings=C.Settings(include_ignored=True),
    )
    return df.select(
        "stream_id", "seg_id", "selected_reference", "edition", "confidence"
    )


_LIVE_UTT = "utt AS (SELECT stream_id * 100 + seg_id AS utt_id, text FROM cue_segments)"
_LIVE_VARIANTS = rf"""
g0 AS (SELECT stream_id * 100 + seg_id AS utt_id, text FROM rules WHERE rule_score >= 0.40 AND len({B.sql_words('text')}) >= 3),
v0 AS (SELECT utt_id, text, {B.sql_words('text')} AS ws,
  list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace({B.sql_trim('s')}, '[.,; ]+$', '')) AS clauses FROM g0),
v1 AS (SELECT utt_id, text, list_concat(list_concat([text], CASE WHEN len(ws) > 20 AND array_to_string(ws[len(ws) - 19:], ' ') <> text THEN [array_to_string(ws[len(ws) - 19:], ' ')] ELSE [] END),
  list_filter(clauses, lambda c: len({B.sql_words('c')}) >= 3 AND c <> text)) AS vs FROM v0),
v2 AS (SELECT utt_id, text, vs, unnest(range(1, len(vs) + 1)) AS i FROM v1),
variants AS (SELECT utt_id, text AS candidate_text, row_number() OVER (PARTITION BY utt_id ORDER BY i) - 1 AS variant_no, vs[i] AS variant
  FROM v2 WHERE list_position(vs, vs[i]) = i)"""


@query(f"""
WITH {B.PASSAGES}, {_P_BOW}, {B.CUE_SEGMENTS}, {_FLAGS}, {_LIVE_VARIANTS},
{B.bow_ctes("q", "variants", "utt_id, variant_no", "variant", True)}, {_hits("utt_id, variant_no", 10, "variants")},
{_ranked("utt_id, variant_no", "variants", "candidate_text")},
pv AS (SELECT utt_id, variant_no, final AS confidence, work || ' ' || section || ':' || item AS reference, edition, passage_id FROM ranked WHERE pos = 1),
bv AS (SELECT * FROM pv QUALIFY row_number() OVER (PARTITION BY utt_id ORDER BY confidence DESC, variant_no) = 1),
ag AS (SELECT bv.utt_id, bv.reference, bv.edition, bv.passage_id, bv.variant_no, bv.confidence, count(*) AS agree FROM bv JOIN pv ON pv.utt_id = bv.utt_id AND pv.reference = bv.reference GROUP BY ALL),
bo AS (SELECT *, least(1::DOUBLE, confidence + CASE WHEN agree >= 2 THEN least(0.12::DOUBLE, 0.03::DOUBLE * (agree - 1)) ELSE 0::DOUBLE END) AS c2 FROM ag)
SELECT utt_id, reference, bo.edition, passages.text AS passage_text, variant_no::INTEGER AS variant_no, agree::INTEGER AS agree, {R4("c2", 4)} AS confidence,
  CASE WHEN c2 >= 0.60 THEN 'autopilot-eligible' ELSE 'review queue' END AS confidence_band FROM bo JOIN passages USING (passage_id) WHERE c2 >= 0.45
""")
def live_detections(spark, sf):
    utts = B.cue_segments(spark, sf).select(
        (F.col("stream_id") * 100 + F.col("seg_id")).alias("utt_id"), "text"
    )
    df = D.detect_utterances(utts, B.passages(spark, sf))
    return df.withColumn("confidence", records.round_at(F.col("confidence"), 4))


@query(f"""
WITH {B.LIVE_LOG}
SELECT seq, {R4("confidence", 4)} AS confidence FROM log WHERE confidence >= 0.45
""")
def live_floor(spark, sf):
    df = live.live_floor(B.live_log(spark, sf))
    return df.select("seq", records.round_at(F.col("confidence"), 4).alias("confidence"))


# ---- signals from earlier acceptances --------------------------------------------------------------
def _history_frames(spark, sf):
    log = B.live_log(spark, sf)
    work = B.pick(B.WORK_POOL, F.col("item"))
    words = F.array(
        F.concat(F.lit("k"), (F.col("item") % 10).cast("string")),
        F.concat(F.lit("w"), (F.col("item") % 7).cast("string")),
    )
    rows = log.select(
        "stream_id", "seq", "kind", work.alias("work"),
        F.concat(work, F.lit(" "), (F.col("item") % 5).cast("string")).alias("reference"),
        words.alias("keywords"),
    )
    return rows, rows.filter(F.col("kind") == "present")


_HISTORY = f"""{B.LIVE_LOG},
c AS (SELECT stream_id, seq, kind, {B.sql_pick(B.WORK_POOL, "item")} AS work, {B.sql_pick(B.WORK_POOL, "item")} || ' ' || (item % 5) AS reference,
  ['k' || (item % 10), 'w' || (item % 7)] AS kws FROM log),
acc AS (SELECT * FROM c WHERE kind = 'present')"""


@query(f"""
WITH {_HISTORY}
SELECT c.stream_id, c.seq, CASE WHEN r.s < c.seq THEN 1.0::DOUBLE WHEN w.s < c.seq THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS history
FROM c LEFT JOIN (SELECT stream_id, reference, min(seq) AS s FROM acc GROUP BY ALL) r USING (stream_id, reference)
LEFT JOIN (SELECT stream_id, work, min(seq) AS s FROM acc GROUP BY ALL) w ON w.stream_id = c.stream_id AND w.work = c.work
""")
def history_score(spark, sf):
    rows, accepted = _history_frames(spark, sf)
    return rerank.history_score(rows, accepted, "stream_id", "seq").select("stream_id", "seq", "history")


@query(f"""
WITH {_HISTORY},
t AS (SELECT *, count(*) FILTER (kind = 'present') OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS total,
  count(*) FILTER (kind = 'present') OVER (PARTITION BY stream_id, work ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS of_work FROM c),
ks AS (SELECT stream_id, kw, min(seq) AS s FROM (SELECT stream_id, seq, unnest(kws) AS kw FROM acc) GROUP BY ALL),
kc AS (SELECT c.stream_id, c.seq, avg(CASE WHEN ks.s < c.seq THEN 1::DOUBLE ELSE 0::DOUBLE END) AS share
  FROM (SELECT stream_id, seq, unnest(kws) AS kw FROM c) c LEFT JOIN ks USING (stream_id, kw) GROUP BY ALL)
SELECT stream_id, seq, {R4('''0.5::DOUBLE * CASE WHEN of_work > 0 THEN greatest(of_work::DOUBLE / greatest(total, 1), 0.5::DOUBLE) ELSE 0::DOUBLE END
  + 0.5::DOUBLE * share''', 5)} AS context FROM t JOIN kc USING (stream_id, seq)
""")
def context_score(spark, sf):
    rows, accepted = _history_frames(spark, sf)
    rows = rows.withColumn("cand", F.lit(0))
    df = rerank.context_score(rows, accepted, "stream_id", "seq", "cand")
    return df.select("stream_id", "seq", records.round_at(F.col("context"), 5).alias("context"))


@query(f"""
WITH {B.LIVE_LOG}
SELECT {B.sql_pick(B.WORK_POOL, "item")} AS work, count(*) AS n FROM log WHERE kind = 'present' GROUP BY 1
""")
def works_by_frequency(spark, sf):
    _, accepted = _history_frames(spark, sf)
    return accepted.groupBy("work").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "work")


def _hybrid(spark, sf):
    """The hybrid gate with a model trained on rule-labelled turns."""
    from ..operators import training

    rows = B.cue_segments(spark, sf)
    gated = detect.rule_gate(rows, "text")
    labels = gated.select("text", (F.col("rule_score") >= 0.4).cast("int").alias("label"))
    scorer = training.scorer(training.train(labels, max_iter=10))
    df = detect.hybrid_gate(rows, scorer, "text")
    return df.select("stream_id", "seg_id", F.col("quote_prob").alias("score"), "source")


@query()
def hybrid_scores(spark, sf):
    """Rules decide where one fires, the model scores the rest."""
    return _hybrid(spark, sf)


@query(f"""
WITH {B.CUE_SEGMENTS}, {_FLAGS}
SELECT stream_id, seg_id, CASE WHEN n > 0 THEN {R4("rule_score", 4)} END AS rule_part, CASE WHEN sig_cue THEN 'cue' WHEN sig_reference THEN 'reference'
  WHEN sig_attribution THEN 'attribution' WHEN sig_work THEN 'book_name' ELSE 'model' END AS source FROM rules
""")
def hybrid_sources(spark, sf):
    """Who decides each turn, and the rules' scores where they do."""
    ruled = F.when(F.col("source") != "model", records.round_at(F.col("score"), 4))
    return _hybrid(spark, sf).select("stream_id", "seg_id", ruled.alias("rule_part"), "source")
