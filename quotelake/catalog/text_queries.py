"""Sentences, windows, token sets, rule signals and text expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import signals as S
from ..functions import text as T
from ..functions import vectors as V
from ..operators import detect, ordered, records, sentences as SE, synthetic
from ..operators.ordered import Axis
from . import bindings as B
from .bindings import query


@query(rf"""
WITH s AS (SELECT doc_id, {B.sql_sentences('text')} AS ss FROM documents)
SELECT doc_id, (i - 1)::BIGINT AS sent_id, ss[i] AS candidate_text
FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM s)
""")
def document_sentences(spark, sf):
    return SE.document_sentences(B.table(spark, sf, "documents").select("doc_id", "text"))


WINDOW_SQL = rf"""
sents AS (
  SELECT {{keys}}, {{order}}, i, ss[i] AS candidate_text FROM (
    SELECT *, unnest(range(1, len(ss) + 1)) AS i
    FROM (SELECT *, {B.sql_sentences('text')} AS ss FROM {{source}}))),
numbered AS (
  SELECT *, row_number() OVER w - 1 AS sent_id,
         coalesce(lag(candidate_text) OVER w, '') AS prev_text,
         array_to_string(flatten(list({B.sql_words('candidate_text')}) OVER
           (PARTITION BY {{keys}} ORDER BY {{order}}, i ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING))[1:12], ' ')
           AS next0
  FROM sents WINDOW w AS (PARTITION BY {{keys}} ORDER BY {{order}}, i)),
windows AS (
  SELECT * EXCLUDE (next0), coalesce(next0, '') AS next_text,
         array_to_string(list_filter([prev_text, candidate_text, coalesce(next0, '')], lambda p: p <> ''), ' ') AS text
  FROM numbered)"""


SENTENCE_WINDOWS = f"""
WITH {B.SEGMENTS}, {WINDOW_SQL.format(keys="stream_id", order="seg_id", source="segments")}
SELECT stream_id, seg_id, sent_id, candidate_text, prev_text, next_text, text,
       seg_id * 10.0::DOUBLE AS start_time, seg_id * 10.0::DOUBLE + 10 AS end_time
FROM windows
"""


@query(SENTENCE_WINDOWS)
def sentence_windows(spark, sf):
    return SE.segment_windows(B.segments(spark, sf)).select(
        "stream_id", "seg_id", "sent_id", "candidate_text", "prev_text", "next_text", "text",
        "start_time", "end_time",
    )


@query(f"""
WITH {B.SEGMENTS}, {WINDOW_SQL.format(keys="stream_id", order="seg_id", source="segments")}
SELECT stream_id, sent_id, candidate_text FROM windows
""")
def segment_sentences(spark, sf):
    return SE.segment_sentences(B.segments(spark, sf)).select("stream_id", "sent_id", "candidate_text")


@query(f"""
WITH d AS (SELECT doc_id, 1 AS o, text FROM documents),
{WINDOW_SQL.format(keys="doc_id", order="o", source="d")}
SELECT doc_id, sent_id, candidate_text, prev_text, next_text, text FROM windows
""")
def document_windows(spark, sf):
    return SE.document_windows(B.table(spark, sf, "documents").select("doc_id", "text"))


@query(rf"""
WITH r AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN '' ELSE text END AS t FROM conversations),
w AS (SELECT *, coalesce(lag(t) OVER o, '') AS prev_text,
  array_to_string(({B.sql_words("coalesce(lead(t) OVER o, '')")})[1:12], ' ') AS next_text
  FROM r WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, t AS candidate_text, prev_text, next_text,
  array_to_string(list_filter([prev_text, t, next_text], lambda p: p <> ''), ' ') AS text
FROM w WHERE t <> ''
""")
def boundary_windows(spark, sf):
    rows = B.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "system", "").otherwise(F.col("text")).alias("text")
    )
    return SE.boundary_windows(rows, "conv_id", "turn").select(
        "conv_id", "turn", "candidate_text", "prev_text", "next_text", "text"
    )


def _word_rows(spark, sf):
    rows = B.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("stream_id"), "turn", F.posexplode(T.words(F.col("text"))).alias("pos", "word")
    )
    at = F.col("turn") * 1000000 + F.col("pos")
    return rows.select(
        "stream_id", at.cast("long").alias("word_id"), "word",
        (F.col("pos") * 0.5).alias("start_time"), (F.col("pos") * 0.5 + 0.5).alias("end_time"),
    )


@query(rf"""
WITH ws AS (SELECT conv_id, turn, {B.sql_words('text')} AS ws FROM conversations),
w AS (SELECT conv_id AS stream_id, turn * 1000000 + i - 1 AS word_id, ws[i] AS word,
             (i - 1) * 0.5::DOUBLE AS start_time, (i - 1) * 0.5::DOUBLE + 0.5::DOUBLE AS end_time
      FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM ws)),
g AS (SELECT *, coalesce(sum(regexp_matches(word, '[.!?][''"]?$')::INTEGER) OVER
        (PARTITION BY stream_id ORDER BY word_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sent_id
      FROM w)
SELECT stream_id, sent_id, string_agg(word, ' ' ORDER BY word_id) AS candidate_text,
       arg_min(start_time, word_id) AS start_time, arg_max(end_time, word_id) AS end_time
FROM g GROUP BY stream_id, sent_id
""")
def word_sentences(spark, sf):
    return SE.word_sentences(_word_rows(spark, sf))


def _overlapping(spark, sf):
    """Turns that repeat the last words of the turn before, as overlapping audio chunks do."""
    axis = Axis(("conv_id",), ("turn",))
    turns = ordered.carry_last(B.table(spark, sf, "conversations"), axis, {"_before": F.col("text")})
    before = T.words(F.coalesce("_before", F.lit("")))
    n = F.least(F.size(before), (F.col("turn") % 13).cast("int"))
    head = F.array_join(F.slice(before, F.size(before) - n + 1, n), " ")
    return turns.select(
        "conv_id", "turn", F.trim(F.concat(head, F.lit(" "), "text")).alias("text")
    )


_OVERLAP_CTE = rf"""
o AS (SELECT conv_id, turn, text, {B.sql_words("coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '')")} AS pw
      FROM conversations),
seg AS (SELECT conv_id, turn,
  trim(array_to_string(CASE WHEN least(len(pw), turn % 13) = 0 THEN [] ELSE pw[len(pw) - least(len(pw), turn % 13) + 1:] END, ' ')
       || ' ' || text, ' ') AS text FROM o)"""


def _shared(pw: str, nw: str) -> str:
    return (
        f"coalesce(list_max(list_filter(range(1, 11), lambda k: k <= len({pw}) AND k <= len({nw}) "
        f"AND {pw}[len({pw}) - k + 1:] = {nw}[1:k])), 0)"
    )


@query(rf"""
WITH {_OVERLAP_CTE},
p AS (SELECT conv_id, turn, text, {B.sql_words('text')} AS nw,
        {B.sql_words("coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '')")} AS pw FROM seg),
k AS (SELECT *, {_shared('pw', 'nw')}::INTEGER AS dropped FROM p)
SELECT conv_id, turn, dropped, CASE WHEN dropped = 0 THEN text ELSE array_to_string(nw[dropped + 1:], ' ') END AS trimmed
FROM k WHERE trim(trimmed, ' ') <> ''
""")
def overlap_trim_lag(spark, sf):
    return SE.overlap_trim_lag(_overlapping(spark, sf), "conv_id", "turn").select(
        "conv_id", "turn", "dropped", "trimmed"
    )


ORACLE_OVERLAP_EXACT = rf"""
WITH RECURSIVE {_OVERLAP_CTE.strip()},
n AS (SELECT conv_id, turn, text, {B.sql_words('text')} AS nw,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM seg),
f AS (
  SELECT conv_id, turn, r, text, nw, 0::INTEGER AS dropped, nw AS state FROM n WHERE r = 1
  UNION ALL
  SELECT conv_id, turn, r, text, nw, k, CASE WHEN k < len(nw) THEN nw[k + 1:] ELSE nw END
  FROM (SELECT n.*, {_shared('f.state', 'n.nw')}::INTEGER AS k FROM n JOIN f ON n.conv_id = f.conv_id AND n.r = f.r + 1))
SELECT conv_id, turn, dropped, CASE WHEN dropped = 0 THEN text ELSE array_to_string(nw[dropped + 1:], ' ') END AS trimmed
FROM f WHERE trim(trimmed, ' ') <> ''
"""


@query(ORACLE_OVERLAP_EXACT)
def overlap_trim_exact(spark, sf):
    return SE.overlap_trim_exact(_overlapping(spark, sf), "conv_id", "turn").select(
        "conv_id", "turn", "dropped", "trimmed"
    )


@query(f"""
SELECT word AS keyword, count(*) AS n, count(DISTINCT doc_id) AS n_docs
FROM (SELECT doc_id, unnest({B.sql_tokens('text', L.KEYWORD_STOP)}) AS word FROM documents)
GROUP BY word
""")
def keyword_tokens(spark, sf):
    # one row per (document, keyword) first, so the distinct count needs no second shuffle of tokens
    per_doc = B.table(spark, sf, "documents").select(
        "doc_id", F.explode(T.keywords(F.col("text"))).alias("keyword")
    ).groupBy("keyword", "doc_id").agg(F.count("*").alias("c"))
    return per_doc.groupBy("keyword").agg(F.sum("c").alias("n"), F.count("*").alias("n_docs"))


@query(rf"""
SELECT min(doc_id) AS doc_id, length(norm)::INTEGER AS norm_length FROM (
  SELECT doc_id, regexp_replace({B.sql_trim('lower(text)')}, '\s+', ' ', 'g') AS norm FROM documents)
GROUP BY norm
""")
def norm_text_dedupe(spark, sf):
    docs = B.table(spark, sf, "documents").select(
        "doc_id", "text", F.length(T.norm_text(F.col("text"))).alias("norm_length")
    )
    return synthetic.unseen(docs, None, "doc_id", keep=["doc_id", "norm_length"])


_FLAGS = f"""
flags AS (
  SELECT *, regexp_matches(lower(text), {B.lit(L.CUE_PATTERN)}) AS sig_cue,
    regexp_matches(text, {B.re2(L.NAMED_REF_PATTERN)}) OR regexp_matches(text, {B.re2(L.BARE_REF_PATTERN)}) AS sig_reference,
    regexp_matches(lower(text), {B.re2(L.ATTRIBUTION_PATTERN)})
      OR regexp_matches(lower(text), {B.re2(L.INVERTED_PATTERN)}) AS sig_attribution,
    regexp_matches(lower(text), {B.re2(L.WORK_NAME_PATTERN)}) AS sig_work
  FROM cue_segments),
scored AS (
  SELECT *, sig_cue::INTEGER + sig_reference::INTEGER + sig_attribution::INTEGER + sig_work::INTEGER AS n FROM flags),
rules AS (
  SELECT *, CASE WHEN n = 0 THEN 0.05::DOUBLE ELSE least(0.99::DOUBLE, 0.92::DOUBLE + 0.03::DOUBLE * (n - 1)) END AS rule_score
  FROM scored)"""
_WORK_BODY = L.WORK_NAME_PATTERN[2:-2]


@query(f"""
WITH {B.CUE_SEGMENTS}, {_FLAGS}
SELECT stream_id, seg_id, sig_cue, sig_reference, sig_attribution, sig_work,
  nullif(regexp_extract(lower(text), {B.lit(B.START + "(" + _WORK_BODY + ")" + B.END)}, 1), '') AS matched_work
FROM rules
""")
def signal_flags(spark, sf):
    df = S.with_signals(B.cue_segments(spark, sf), "text")
    return df.select(
        "stream_id", "seg_id", "sig_cue", "sig_reference", "sig_attribution", "sig_work",
        S.matched_work(F.col("text")).alias("matched_work"),
    )


@query(f"""
WITH {B.CUE_SEGMENTS}, {_FLAGS}
SELECT stream_id, seg_id, {B.sql_round('rule_score', 4)} AS rule_score,
  CASE WHEN sig_cue THEN 'cue' WHEN sig_reference THEN 'reference' WHEN sig_attribution THEN 'attribution'
       WHEN sig_work THEN 'book_name' ELSE 'none' END AS source,
  CASE WHEN rule_score >= 0.40 THEN 'scripture' ELSE 'not_scripture' END AS prediction
FROM rules
""")
def rule_scores(spark, sf):
    df = detect.rule_gate(B.cue_segments(spark, sf), "text")
    return df.select(
        "stream_id", "seg_id", records.round_at(F.col("rule_score"), 4).alias("rule_score"),
        S.signal_source().alias("source"), S.prediction(F.col("rule_score")).alias("prediction"),
    )


@query(f"""
WITH {B.CUE_SEGMENTS}, {_FLAGS}
SELECT stream_id, seg_id, text FROM rules WHERE rule_score >= 0.40
""")
def quote_gate(spark, sf):
    df = detect.rule_gate(B.cue_segments(spark, sf), "text")
    return detect.passed(df).select("stream_id", "seg_id", "text")


@query(f"""
WITH {B.CUE_SEGMENTS}, {_FLAGS}
SELECT stream_id, seg_id, model >= 0.40 OR rule_score >= 0.15 AS searched FROM (
  SELECT *, CASE WHEN (seg_id + stream_id) % 2 = 0 THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END AS model FROM rules)
""")
def rescue_gate(spark, sf):
    df = detect.rule_gate(B.cue_segments(spark, sf), "text")
    model = F.when((F.col("seg_id") + F.col("stream_id")) % 2 == 0, 0.5).otherwise(0.1)
    return df.select("stream_id", "seg_id", S.rescued(model, F.col("rule_score")).alias("searched"))


@query(f"""
SELECT doc_id, {B.sql_md5_bucket('word')} AS dim, count(*) AS n FROM (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS word FROM documents)
WHERE length(word) > 2 GROUP BY ALL
""")
def hashed_bow(spark, sf):
    dims = V.bow_dims(B.table(spark, sf, "documents"), ["doc_id"], "text")
    return dims.groupBy("doc_id", F.col("dim").cast("long").alias("dim")).agg(F.count("*").alias("n"))


_VARIANTS = rf"""
v0 AS (SELECT conv_id, turn, text, {B.sql_words('text')} AS ws,
         list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
           lambda s: regexp_replace({B.sql_trim('s')}, '[.,; ]+$', '')) AS clauses FROM conversations),
v1 AS (SELECT conv_id, turn, list_concat(list_concat([text],
         CASE WHEN len(ws) > 20 AND array_to_string(ws[len(ws) - 19:], ' ') <> text THEN [array_to_string(ws[len(ws) - 19:], ' ')] ELSE [] END),
         list_filter(clauses, lambda c: len({B.sql_words('c')}) >= 3 AND c <> text)) AS vs FROM v0),
v2 AS (SELECT conv_id, turn, vs, unnest(range(1, len(vs) + 1)) AS i FROM v1),
variants AS (SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1)::INTEGER AS variant_no, vs[i] AS variant
  FROM v2 WHERE list_position(vs, vs[i]) = i)"""


@query(f"WITH {_VARIANTS} SELECT * FROM variants")
def query_variants(spark, sf):
    return B.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.posexplode(T.query_variants(F.col("text"))).alias("variant_no", "variant")
    )


@query(rf"""
SELECT page_id, regexp_replace(url, '[^\p{{L}}\p{{N}}\-_.]', '_', 'g') AS safe_id,
  length(regexp_replace({B.sql_trim('lower(html)')}, '\s+', ' ', 'g'))::INTEGER AS norm_length FROM pages
""")
def page_identifiers(spark, sf):
    return B.table(spark, sf, "pages").select(
        "page_id", T.safe_identifier(F.col("url")).alias("safe_id"),
        F.length(T.norm_text(F.col("html"))).alias("norm_length"),
    )


@query(rf"""
SELECT doc_id, {B.sql_words('text')}[1] AS first_word, len({B.sql_words('text')})::INTEGER AS n_words,
  (n_chars // 3600)::VARCHAR || ':' || lpad(((n_chars % 3600) // 60)::VARCHAR, 2, '0') || ':' || lpad((n_chars % 60)::VARCHAR, 2, '0') AS clock
FROM documents WHERE len({B.sql_words('text')}) >= 3
""")
def minimum_words(spark, sf):
    docs = detect.min_words(B.table(spark, sf, "documents"), "text")
    w = T.words(F.col("text"))
    return docs.select(
        "doc_id", F.get(w, 0).alias("first_word"), F.size(w).alias("n_words"),
        T.clock(F.col("n_chars")).alias("clock"),
    )


@query(f"""
WITH {B.LIVE_LOG}
SELECT seq, stream_id FROM (SELECT *, CASE WHEN kind <> 'mode' THEN item / 100.0::DOUBLE END AS ns,
  CASE WHEN kind <> 'present' THEN -value / 50 END AS lp FROM log)
WHERE coalesce(ns, 0) <= 0.6 AND coalesce(lp, 0) >= -0.8
""")
def asr_quality(spark, sf):
    log = B.live_log(spark, sf).withColumns(
        {
            "no_speech_prob": F.when(F.col("kind") != "mode", F.col("item") / 100.0),
            "avg_logprob": F.when(F.col("kind") != "present", -F.col("value") / 50),
            "text": F.col("kind"),
        }
    )
    return detect.asr_quality(log).select("seq", "stream_id")


@query(f"""
WITH {B.LIVE_LOG}
SELECT CASE WHEN confidence >= 0.60 THEN 'autopilot-eligible' WHEN confidence >= 0.40 THEN 'review queue' ELSE 'ignored' END AS band,
       count(*) AS n FROM log GROUP BY 1
""")
def band_counts(spark, sf):
    log = B.live_log(spark, sf).withColumn("confidence_band", T.band(F.col("confidence")))
    return records.band_counts(log)
