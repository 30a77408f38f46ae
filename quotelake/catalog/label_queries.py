"""Labelling, cleaning, triage, splits, metrics and synthetic-row validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as T
from ..operators import labels as LB
from ..operators import records, sentences as SE, synthetic, training, triage
from ..plans import datasets
from ..session import saved
from . import bindings as B
from .bindings import query

R4 = B.sql_round
NAMES = {"src1": "person 1", "src12": "person 2", "src3": "person 3"}


# ---- documents joined with their quality label, the rows of the training jobs --------------------
def _labelled(spark, sf):
    docs, marks = B.table(spark, sf, "documents"), B.table(spark, sf, "labels")
    gold = F.when(F.col("quality") == 1, "positive").otherwise("negative")
    return docs.join(marks, "doc_id").select("doc_id", "text", "source", gold.alias("label"), "quality", "toxic")


_LABELLED = """labelled AS (
  SELECT doc_id, text, source, CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS label, quality, toxic
  FROM documents JOIN labels USING (doc_id))"""


def _raw_labels(spark, sf):
    """Labels as people type them: blanks, capitals, typos and inconsistent subtypes."""
    n = F.col("n_chars")
    label = F.when(n % 5 == 0, " Positive ").when(n % 5 == 1, "NEGATIVE").when(n % 5 == 2, "positive").when(n % 5 == 3, "maybe")
    sub = F.when(n % 3 == 0, "Explicit_Reference").when(n % 3 == 1, "negative")
    text = F.when(n % 7 == 0, F.concat(F.lit("John 3:16 "), "text")).otherwise(F.col("text"))
    return B.table(spark, sf, "documents").select(
        "doc_id", text.alias("text"), "source", label.alias("label"), sub.alias("subtype")
    )


_RAW = """raw AS (
  SELECT doc_id, source, CASE WHEN n_chars % 7 = 0 THEN 'John 3:16 ' || text ELSE text END AS text,
    CASE n_chars % 5 WHEN 0 THEN ' Positive ' WHEN 1 THEN 'NEGATIVE' WHEN 2 THEN 'positive' WHEN 3 THEN 'maybe' END AS label,
    CASE n_chars % 3 WHEN 0 THEN 'Explicit_Reference' WHEN 1 THEN 'negative' END AS subtype FROM documents)"""
_HAS_REF = f"regexp_matches(text, {B.re2(L.LABEL_REF_PATTERN)})"


def _suggested(source):
    return f"""t AS (SELECT *, {_HAS_REF} AS has_ref,
  len(list_intersect({B.sql_words('lower(text)')}, {B.sql_list(L.ARCHAIC_WORDS)})) > 0 AS archaic,
  regexp_matches(lower(text), {B.lit(L.either(L.NEGATIVE_MARKERS))}) AS neg FROM {source}),
s AS (SELECT *, greatest(0::DOUBLE, least(1::DOUBLE, 0.1::DOUBLE + CASE WHEN trig <> '' THEN 0.5::DOUBLE ELSE 0::DOUBLE END
  + CASE WHEN has_ref THEN 0.5::DOUBLE ELSE 0::DOUBLE END + CASE WHEN archaic THEN 0.3::DOUBLE ELSE 0::DOUBLE END
  - CASE WHEN neg THEN 0.4::DOUBLE ELSE 0::DOUBLE END)) AS auto_score FROM t)"""


_SUGGESTED_LABEL = """CASE WHEN NOT neg AND auto_score >= 0.5 THEN 'positive' ELSE 'negative' END AS label,
  CASE WHEN neg OR auto_score < 0.5 THEN 'negative' WHEN has_ref THEN 'explicit_reference' ELSE 'cue_phrase' END AS subtype"""


@query(f"""
WITH {_RAW}, said AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'john' ELSE '' END AS trig FROM raw), {_suggested("said")}
SELECT doc_id, {R4('auto_score', 2)} AS auto_score, {_SUGGESTED_LABEL} FROM s
""")
def suggest_label(spark, sf):
    rows = _raw_labels(spark, sf).drop("label", "subtype").withColumn(
        "matched_trigger", F.when(F.col("doc_id") % 3 == 0, "john").otherwise("")
    )
    df = LB.suggest(rows)
    return df.select(
        "doc_id", records.round_at(F.col("auto_score"), 2).alias("auto_score"), "label", "subtype"
    )


_ANON = """CASE WHEN contains(lower(source), 'src3') THEN 'person 3' WHEN contains(lower(source), 'src12') THEN 'person 2'
  WHEN contains(lower(source), 'src1') THEN 'person 1' ELSE source END"""


@query(f"""
WITH {_RAW}, c AS (SELECT *, {B.sql_trim("lower(coalesce(label, ''))")} AS l, {B.sql_trim("lower(coalesce(subtype, ''))")} AS s FROM raw)
SELECT doc_id, l AS label, CASE WHEN l = 'negative' THEN 'negative' WHEN s IN ('cue_phrase', 'explicit_reference') THEN s
  WHEN {_HAS_REF} THEN 'explicit_reference' ELSE 'cue_phrase' END AS subtype, {_ANON} AS source_file
FROM c WHERE l IN ('positive', 'negative')
""")
def clean_labels(spark, sf):
    rows = _raw_labels(spark, sf).withColumnRenamed("source", "source_file")
    good, _ = datasets.clean_labels(rows, NAMES)
    return good.select("doc_id", "label", "subtype", "source_file")


@query(f"WITH {_RAW} SELECT doc_id, label FROM raw WHERE {B.sql_trim('''lower(coalesce(label, ''))''')} NOT IN ('positive', 'negative')")
def dropped_labels(spark, sf):
    return LB.repair_labels(_raw_labels(spark, sf))[1].select("doc_id", "label")


@query("""
SELECT DISTINCT source FROM documents WHERE NOT (contains(lower(source), 'src1') OR contains(lower(source), 'src12') OR contains(lower(source), 'src3'))
""")
def unmapped_names(spark, sf):
    return LB.unmapped(B.table(spark, sf, "documents"), "source", NAMES)


@query(f"WITH {_LABELLED} SELECT label, toxic, count(*) AS n, {R4('count(*)::DOUBLE / (SELECT count(*) FROM labelled)', 6)} AS share FROM labelled GROUP BY label, toxic")
def label_distribution(spark, sf):
    df = LB.distribution(_labelled(spark, sf), ["label", "toxic"])
    return df.withColumn("share", records.round_at(F.col("share"), 6))


@query("""
SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r FROM documents) WHERE r >= 10 AND r < 40
""")
def row_slices(spark, sf):
    """Rows 10 to 40 of every source in file order (the slice is the operator)."""
    docs = B.table(spark, sf, "documents").select("doc_id", "source")
    return LB.row_slice(docs, ["source"], "doc_id", 10, 40)


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS line_no FROM documents")
def numbered_lines(spark, sf):
    docs = B.table(spark, sf, "documents").select("doc_id", "source")
    return SE.numbered_lines(docs, ["source"], "doc_id")


# ---- forced breaks and greedy lines ------------------------------------------------------------------
_TRIGGER_WORK = ["john", "open your bible", "it says in the niv", "turn with me to", "as we read", "according"]


def _files(spark, sf):
    """Every document as a transcript file, with a spoken trigger worked into its text."""
    text = F.concat(F.col("text"), F.lit(" then "), B.pick(_TRIGGER_WORK, F.col("doc_id")), F.lit(" says so."))
    return B.table(spark, sf, "documents").select("doc_id", T.words(text).alias("words"))


_JAVA_TRIGGER = L.either(L.trigger_table())
_BLANKS = "length({x}) - length(replace({x}, ' ', ''))"
_BREAKS = rf"""
f AS (SELECT doc_id, regexp_replace(array_to_string({B.sql_words(f"text || ' then ' || {B.sql_pick(_TRIGGER_WORK, 'doc_id')} || ' says so.'")}, ' '), '[^\x00-\x7F\p{{P}}\p{{S}}\p{{Z}}]', 'q', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_split_to_array(t, {B.lit(r"(?i)\b" + _JAVA_TRIGGER + r"\b")}) AS gaps, regexp_extract_all(t, {B.lit(r"(?i)\b" + _JAVA_TRIGGER + r"\b")}) AS hits FROM f),
u AS (SELECT doc_id, i, gaps[i] AS gap, hits[i] AS hit FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM b)),
p AS (SELECT doc_id, i, lower(hit) AS phrase, (sum({_BLANKS.format(x='gap')}) OVER w + coalesce(sum({_BLANKS.format(x='hit')}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS word
  FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
tt(phrase, back) AS (VALUES {", ".join(f"({B.lit(k)}, {v})" for k, v in sorted(L.trigger_table().items()))}),
m AS (SELECT doc_id, i, phrase, greatest(0, word - back) AS pos_at FROM p JOIN tt USING (phrase)),
br AS (SELECT doc_id, pos_at::INTEGER AS "at", arg_min(phrase, i) AS phrase FROM m GROUP BY doc_id, pos_at)"""


@query(f"WITH {_BREAKS} SELECT * FROM br")
def break_positions(spark, sf):
    return LB.break_rows(LB.break_positions(_files(spark, sf)), ["doc_id"])


# the next break kept is the first at least five words after the last one
_THIN = """
ats AS (SELECT doc_id, list("at" ORDER BY "at") AS a FROM br GROUP BY doc_id),
th AS (SELECT doc_id, a[1] AS "at", a FROM ats UNION ALL
  SELECT doc_id, nxt, a FROM (SELECT doc_id, a, list_min(list_filter(a, lambda x: x >= "at" + 5)) AS nxt FROM th) WHERE nxt IS NOT NULL),
kept AS MATERIALIZED (SELECT doc_id, "at", phrase FROM th JOIN br USING (doc_id, "at"))"""


@query(f"WITH RECURSIVE {_BREAKS}, {_THIN} SELECT * FROM kept")
def thin_breaks(spark, sf):
    return LB.break_rows(LB.thin_breaks(LB.break_positions(_files(spark, sf))), ["doc_id"])


_LINES = rf"""
fw AS (SELECT doc_id, {B.sql_words(f"text || ' then ' || {B.sql_pick(_TRIGGER_WORK, 'doc_id')} || ' says so.'")} AS words FROM documents),
w AS MATERIALIZED (SELECT doc_id, words, len(words) AS n, list_transform(words, lambda x: regexp_matches(x, '[.?!]\s*$')) AS closes, coalesce(a, []) AS a
  FROM fw LEFT JOIN (SELECT doc_id, list("at" ORDER BY "at") AS a FROM kept GROUP BY doc_id) USING (doc_id)),
ln AS (SELECT doc_id, 0 AS line_no, 0::BIGINT AS start, 0::BIGINT AS stop FROM w UNION ALL
  SELECT doc_id, line_no + 1, stop, CASE WHEN nb - stop <= 14 THEN nb ELSE coalesce(stop + 4 + se, least(stop + 9, n)) END
  FROM (SELECT doc_id, line_no, stop, n, list_min(list_filter(a, lambda x: x > stop)) AS nb,
    nullif(list_position(closes[stop + 5:least(stop + 14, n)], TRUE), 0) AS se FROM ln JOIN w USING (doc_id) WHERE stop < n)),
lines AS (SELECT doc_id, line_no, start::INTEGER AS first_word, stop::INTEGER AS next_word, array_to_string(words[start + 1:stop], ' ') AS text, coalesce(phrase, '') AS trig
  FROM ln JOIN w USING (doc_id) LEFT JOIN kept ON kept.doc_id = ln.doc_id AND kept."at" = ln.start WHERE line_no > 0)"""


@query(f"""
WITH RECURSIVE {_BREAKS}, {_THIN}, {_LINES}, {_suggested("lines")}
SELECT doc_id, line_no, first_word, next_word, text, trig AS matched_trigger, auto_score, {_SUGGESTED_LABEL} FROM s
""")
def greedy_lines(spark, sf):
    df = LB.thin_breaks(LB.break_positions(_files(spark, sf)))
    return LB.suggest(LB.build_lines(df))


# ---- duplicates, split, weights, metrics ------------------------------------------------------------------
@query(f"WITH {_LABELLED} SELECT min(doc_id) AS doc_id FROM labelled GROUP BY text")
def dedupe_keep_first(spark, sf):
    return training.keep_first_texts(_labelled(spark, sf), "doc_id").select("doc_id")


@query(f"""
WITH {_LABELLED} SELECT count(*) AS n_before, count(DISTINCT text) AS n_kept, count(*) - count(DISTINCT text) AS n_removed FROM labelled
""")
def removed_counts(spark, sf):
    rows = _labelled(spark, sf)
    return training.removed_counts(rows, training.keep_first_texts(rows, "doc_id"))


@query(f"""
WITH {_LABELLED}, k AS (SELECT min(doc_id) AS doc_id, text FROM labelled GROUP BY text),
r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || k.text)) AS r, count(*) OVER (PARTITION BY label) AS n
  FROM k JOIN labelled USING (doc_id) WHERE label IS NOT NULL)
SELECT doc_id, label, r <= ceil(round(n * 0.1::DOUBLE, 9)) AS is_validation FROM r
""")
def stratified_split(spark, sf):
    split = datasets.prepare_split(_labelled(spark, sf).select("doc_id", "text", "label"), "doc_id")
    return split.select("doc_id", "label", "is_validation")


@query(f"WITH {_LABELLED} SELECT label, count(*) AS n, {R4('(SELECT count(*) FROM labelled)::DOUBLE / (2 * count(*))', 6)} AS weight FROM labelled GROUP BY label")
def class_weights(spark, sf):
    df = training.class_weights(_labelled(spark, sf))
    return df.withColumn("weight", records.round_at(F.col("weight"), 6))


@query("SELECT quality AS label, count(*) FILTER (toxic = 0) AS pred_0, count(*) FILTER (toxic = 1) AS pred_1 FROM labels GROUP BY quality")
def confusion(spark, sf):
    rows = B.table(spark, sf, "labels").select(F.col("quality").alias("label"), F.col("toxic").alias("prediction"))
    return training.confusion(rows)


@query(f"""
WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality <> 1 AND toxic = 1) AS fp,
  count(*) FILTER (quality = 1 AND toxic <> 1) AS fn, count(*) FILTER (quality <> 1 AND toxic <> 1) AS tn FROM labels)
SELECT tp, fp, fn, tn, {R4('coalesce((tp + tn)::DOUBLE / nullif(tp + fp + fn + tn, 0), 0)', 6)} AS accuracy,
  {R4('coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0)', 6)} AS "precision", {R4('coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0)', 6)} AS recall,
  {R4('coalesce((2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0), 0)', 6)} AS f1 FROM c
""")
def binary_metrics(spark, sf):
    rows = B.table(spark, sf, "labels").select(F.col("quality").alias("label"), F.col("toxic").alias("prediction"))
    df = training.binary_metrics(rows)
    return df.withColumns({c: records.round_at(F.col(c), 6) for c in ("accuracy", "precision", "recall", "f1")})


@query()
def train_eval_classifier(spark, sf):
    rows = training.keep_first_texts(_labelled(spark, sf).select("doc_id", "text", F.col("quality").alias("label")), "doc_id")
    # joined and split once: training and scoring are six passes, each of which shuffled all texts twice
    split = saved(training.stratified_split(rows), "split")
    model = training.train(split.filter(~F.col("is_validation")), max_iter=10)
    return training.binary_metrics(training.score(model, split.filter("is_validation")))


# ---- triage ------------------------------------------------------------------------------------------------
def _triage(spark, sf):
    """Documents as triage rows: every document has a confidence, labelled ones also a gold label."""
    docs, marks = B.table(spark, sf, "documents"), B.table(spark, sf, "labels")
    conf = (F.col("n_chars") % 100) / 100.0
    rows = docs.join(marks, "doc_id", "left").select(
        F.col("doc_id").alias("line"), conf.alias("confidence"), T.band(conf).alias("confidence_band"),
        F.when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "negative").alias("label"),
        F.array(F.struct(F.concat(F.lit("John 1:"), F.col("doc_id").cast("string")).alias("reference"), conf.alias("score"))).alias("candidates"),
        F.concat(F.lit("John 1:"), F.col("doc_id").cast("string")).alias("selected_reference"),
    )
    return triage.suggestions(rows)


_TRIAGE = """
tr AS (SELECT doc_id AS line, (n_chars % 100) / 100.0::DOUBLE AS confidence,
  CASE WHEN (n_chars % 100) / 100.0::DOUBLE >= 0.60 THEN 'autopilot-eligible' WHEN (n_chars % 100) / 100.0::DOUBLE >= 0.40 THEN 'review queue' ELSE 'ignored' END AS confidence_band,
  CASE quality WHEN 1 THEN 'positive' WHEN 0 THEN 'negative' END AS label FROM documents LEFT JOIN labels USING (doc_id)),
sg AS (SELECT *, CASE WHEN confidence_band <> 'ignored' THEN 'positive' ELSE 'negative' END AS suggested_label,
  CASE WHEN confidence_band <> 'ignored' THEN 'John 1:' || line ELSE '0' END AS suggested_verse,
  format('John 1:{} ({:.2f})', line, confidence) AS top_candidate FROM tr)"""


@query(f"WITH {_TRIAGE} SELECT line, suggested_label, suggested_verse, top_candidate, confidence_band FROM sg")
def triage_suggestions(spark, sf):
    return _triage(spark, sf).select("line", "suggested_label", "suggested_verse", "top_candidate", "confidence_band")


@query(f"""
WITH {_TRIAGE} SELECT CASE WHEN label = 'positive' AND suggested_label = 'positive' THEN 'caught' WHEN label = 'positive' THEN 'missed'
  WHEN suggested_label = 'negative' THEN 'rejected' ELSE 'flagged' END AS outcome, count(*) AS n FROM sg WHERE label IS NOT NULL GROUP BY 1
""")
def triage_outcomes(spark, sf):
    gold, _, _ = triage.split_rows(_triage(spark, sf).withColumn("text", F.lit("x")))
    return triage.outcome_counts(gold, "label", "suggested_label")


@query(f"""
WITH {_TRIAGE} SELECT line, outcome FROM (SELECT line, CASE WHEN label = 'positive' AND suggested_label = 'negative' THEN 'missed'
  WHEN label = 'negative' AND suggested_label = 'positive' THEN 'flagged' END AS outcome FROM sg) WHERE outcome IS NOT NULL
""")
def triage_wrong_rows(spark, sf):
    gold = _triage(spark, sf).filter(F.col("label").isNotNull())
    return triage.wrong_rows(gold, "label", "suggested_label").select("line", "outcome")


@query(f"""
WITH {_TRIAGE} SELECT line, label, confidence_band, confidence FROM sg
""")
def triage_order(spark, sf):
    return triage.review_order(_triage(spark, sf)).select("line", "label", "confidence_band", "confidence")


@query(f"WITH {_TRIAGE} SELECT line, confidence FROM sg WHERE confidence_band = 'ignored' ORDER BY confidence DESC, line LIMIT 10")
def top_ignored(spark, sf):
    """Top-10 report."""
    return triage.top_ignored(_triage(spark, sf)).select("line", "confidence")


# ---- synthetic rows ---------------------------------------------------------------------------------------------
_SUBTYPES = [*L.SUBTYPE_TARGETS, "made_up"]
_VERSES = ["Gen 1:1", "1 sam 1.2", "genesis 1:3.", "John 9:99", "nobody 1:1", "Exodus 2:5"]


def _synthetic(spark, sf):
    """Every document's text, and beside it the passage of its position, for some with a blank row as well."""
    d = F.col("doc_id")
    docs = B.table(spark, sf, "documents")
    passage = B.passages(spark, sf).filter(F.col("edition") == "AMP").select(
        F.col("passage_id").alias("_pid"), F.col("text").alias("_quote"), "work", "section", "item"
    )
    size = B.table(spark, sf, "benchmark").agg(F.count("*").alias("_size"))  # one row
    df = docs.crossJoin(F.broadcast(size)).withColumn("_pid", (d % F.col("_size")) * 2).join(passage, "_pid", "left")
    own = F.struct(F.lit(0).alias("part"), F.col("text").alias("said"), B.pick(_VERSES, d).alias("verse"))
    quote = F.struct(
        F.lit(1).alias("part"), F.concat(F.lit("  "), F.col("_quote"), F.lit(" ")).alias("said"),
        T.reference(F.col("work"), F.col("section"), F.col("item")).alias("verse"),
    )
    blank = F.struct(F.lit(2).alias("part"), F.lit(" ").alias("said"), B.pick(_VERSES, d).alias("verse"))
    made = F.when(d % 11 == 0, F.array(own, quote, blank)).otherwise(F.array(own, quote))
    return df.select(d, "n_chars", F.explode(made).alias("r")).select(
        (d * 3 + F.col("r.part")).alias("row_id"), F.col("r.said").alias("text"), "r.verse",
        B.pick(_SUBTYPES, F.col("n_chars") + F.col("r.part")).alias("subtype"), F.lit("positive").alias("label"),
    )


_SYN = f"""
syn AS (SELECT doc_id * 3 + part AS row_id, CASE part WHEN 0 THEN d.text WHEN 1 THEN '  ' || p.text || ' ' ELSE ' ' END AS text0,
  CASE WHEN part = 1 THEN work || ' ' || section || ':' || item ELSE {B.sql_pick(_VERSES, "doc_id")} END AS verse0,
  {B.sql_pick(_SUBTYPES, "n_chars + part")} AS subtype FROM documents d LEFT JOIN passages p ON p.edition = 'AMP' AND p.passage_id = (doc_id % (SELECT count(*) FROM benchmark)) * 2
  CROSS JOIN (VALUES (0), (1), (2)) h(part) WHERE part < 2 OR doc_id % 11 = 0),
la(alias, target) AS (VALUES {", ".join(f"({B.lit(k)}, {B.lit(v)})" for k, v in sorted(L.label_aliases().items()))}),
sp AS (SELECT row_id, {B.sql_trim('text0')} AS text, subtype, rtrim(trim(verse0), '.,;') AS vv FROM syn),
sr AS (SELECT *, regexp_replace(lower(trim(regexp_extract(vv, {B.lit(L.STRICT_REF_PATTERN)}, 1))), '\\s+', ' ', 'g') AS tok,
  nullif(regexp_extract(vv, {B.lit(L.STRICT_REF_PATTERN)}, 2), '')::INTEGER AS s, nullif(regexp_extract(vv, {B.lit(L.STRICT_REF_PATTERN)}, 3), '')::INTEGER AS i FROM sp),
sw AS (SELECT sr.*, la.target AS work FROM sr LEFT JOIN la ON la.alias = tok),
ps AS (SELECT work, section AS s, item AS i, list(list_distinct({B.sql_tokens('text', L.OVERLAP_STOP)})) AS sets FROM passages GROUP BY ALL),
sv AS (SELECT sw.*, sets, list_distinct({B.sql_tokens('sw.text', L.OVERLAP_STOP)}) AS mine,
  list_contains({B.sql_list(L.POSITIVE_SUBTYPES)}, subtype) AS pos FROM sw LEFT JOIN ps USING (work, s, i)),
so AS (SELECT *, coalesce(list_max(list_transform(sets, lambda z: len(list_intersect(z, mine)))), 0) AS ov FROM sv),
checked AS (SELECT row_id, text, subtype, CASE WHEN pos THEN work || ' ' || s || ':' || i ELSE '0' END AS verse,
  CASE WHEN pos THEN 'positive' ELSE 'negative' END AS label,
  CASE WHEN text = '' OR length(text) > 500 THEN 'bad_text' WHEN NOT list_contains({B.sql_list(list(L.SUBTYPE_TARGETS))}, subtype) THEN 'bad_subtype'
    WHEN pos AND sets IS NULL THEN 'verse_unresolved' WHEN subtype = 'direct_quote_chopped' AND ov < 3 THEN 'quote_mismatch' END AS drop_reason FROM so)"""


@query(f"WITH {B.PASSAGES}, {_SYN} SELECT row_id, subtype, CASE WHEN drop_reason IS NULL THEN verse END AS verse, label, drop_reason FROM checked")
def validate_rows(spark, sf):
    df = synthetic.validate(_synthetic(spark, sf), B.passages(spark, sf))
    return df.select(
        "row_id", "subtype", F.when(F.col("drop_reason").isNull(), F.col("verse")).alias("verse"), "label", "drop_reason"
    )


@query(f"WITH {B.PASSAGES}, {_SYN} SELECT drop_reason, count(*) AS n FROM checked WHERE drop_reason IS NOT NULL GROUP BY 1")
def drop_reasons(spark, sf):
    return synthetic.drop_counts(synthetic.validate(_synthetic(spark, sf), B.passages(spark, sf)))


_QUOTAS = {"explicit_reference": 10, "paraphrase": 5, "narration_chop": 20}
_ACCEPT = rf"""
good AS (SELECT row_id, text, subtype, regexp_replace({B.sql_trim('lower(text)')}, '\s+', ' ', 'g') AS norm FROM checked WHERE drop_reason IS NULL),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY row_id) AS rn FROM good),
f AS (SELECT 0::BIGINT AS rn, NULL::BIGINT AS row_id, NULL::VARCHAR AS subtype, FALSE AS ok, []::VARCHAR[] AS seen, 0 AS a, 0 AS b, 0 AS c
  UNION ALL
  SELECT rn, row_id, subtype, ok, CASE WHEN ok THEN list_append(seen, norm) ELSE seen END, a + (ok AND subtype = 'explicit_reference')::INTEGER,
    b + (ok AND subtype = 'paraphrase')::INTEGER, c + (ok AND subtype = 'narration_chop')::INTEGER
  FROM (SELECT n.*, f.seen, f.a, f.b, f.c, NOT list_contains(f.seen, n.norm) AND CASE n.subtype WHEN 'explicit_reference' THEN f.a < 10
    WHEN 'paraphrase' THEN f.b < 5 WHEN 'narration_chop' THEN f.c < 20 ELSE FALSE END AS ok FROM f JOIN numbered n ON n.rn = f.rn + 1)),
acc AS (SELECT row_id, subtype FROM f WHERE ok)"""


def _accepted(spark, sf):
    accepted, _ = datasets.validate_synthetic(_synthetic(spark, sf), B.passages(spark, sf), "row_id", targets=_QUOTAS)
    return accepted


@query(f"WITH RECURSIVE {B.PASSAGES}, {_SYN}, {_ACCEPT} SELECT row_id, subtype FROM acc")
def quota_accept(spark, sf):
    return _accepted(spark, sf).select("row_id", "subtype")


@query(f"""
WITH RECURSIVE {B.PASSAGES}, {_SYN}, {_ACCEPT}, g(subtype, target) AS (VALUES ('explicit_reference', 10), ('paraphrase', 5), ('narration_chop', 20))
SELECT g.subtype, g.target::BIGINT AS target, count(acc.row_id) AS accepted, greatest(0, g.target - count(acc.row_id))::BIGINT AS remaining FROM g LEFT JOIN acc USING (subtype) GROUP BY g.subtype, g.target
""")
def quota_progress(spark, sf):
    return synthetic.progress(_accepted(spark, sf), _QUOTAS)


@query(f"""
WITH RECURSIVE {B.PASSAGES}, {_SYN}, {_ACCEPT}
SELECT label, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM acc), 6) AS share FROM acc JOIN checked USING (row_id) GROUP BY label
""")
def label_shares(spark, sf):
    df = synthetic.label_shares(_accepted(spark, sf))
    return df.withColumn("share", F.round("share", 6))


@query("""
WITH p AS (SELECT quality AS y, toxic AS x FROM labels), c AS (SELECT y AS class FROM p UNION SELECT x FROM p)
SELECT class, round(coalesce(count(*) FILTER (y = class AND x = class)::DOUBLE / nullif(count(*) FILTER (x = class), 0), 0), 6) AS precision,
  round(coalesce(count(*) FILTER (y = class AND x = class)::DOUBLE / nullif(count(*) FILTER (y = class), 0), 0), 6) AS recall,
  round(coalesce(2 * count(*) FILTER (y = class AND x = class)::DOUBLE / nullif(count(*) FILTER (y = class) + count(*) FILTER (x = class), 0), 0), 6) AS f1,
  count(*) FILTER (y = class) AS support FROM c CROSS JOIN p GROUP BY class
""")
def class_report(spark, sf):
    rows = B.table(spark, sf, "labels").select(F.col("quality").alias("label"), F.col("toxic").alias("prediction"))
    df = training.class_report(rows)
    return df.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("""
SELECT conv_id, turn, i::INTEGER AS i, text AS value FROM conversations, (VALUES (0), (1)) v(i)
""")
def fenced_json(spark, sf):
    """Rows parsed back out of a fenced JSON array, as a generator returns them."""
    inner = F.to_json(F.array(F.struct("text"), F.struct("text")))
    raw = F.concat(F.lit("```json\n"), inner, F.lit("\n```"))
    parsed = T.json_array(raw, "array<struct<text:string>>")
    df = B.table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(parsed).alias("i", "r"))
    return df.select("conv_id", "turn", "i", F.col("r.text").alias("value"))
