"""Passage lookups, alias resolution, reference parsing and utterance routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import references as R
from ..functions import text as T
from ..operators import lookup, router, synthetic
from ..sources import corpus
from . import bindings as B
from .bindings import query


@query(f"WITH {B.PASSAGES} SELECT edition, work, section, item, text, work || ' ' || section || ':' || item AS reference FROM passages")
def passages_union(spark, sf):
    return corpus.with_reference(B.passages(spark, sf)).drop("passage_id")


@query(rf"""
WITH {B.PASSAGES}
SELECT passage_id, edition FROM passages WHERE len({B.sql_words('text')}) BETWEEN 8 AND 45
""")
def seed_pool(spark, sf):
    return synthetic.seed_pool(B.passages(spark, sf)).select("passage_id", "edition")


@query(f"""
WITH {B.PASSAGES}, {B.ASKED}
SELECT ref_id, edition, work, section, item, text AS passage_text
FROM asked LEFT JOIN passages USING (edition, work, section, item)
""")
def exact_lookup(spark, sf):
    return lookup.exact_lookup(B.asked_refs(spark, sf), B.passages(spark, sf)).select(
        "ref_id", "edition", "work", "section", "item", "passage_text"
    )


@query(f"""
WITH {B.PASSAGES}, {B.ASKED} SELECT ref_id FROM asked SEMI JOIN passages USING (edition, work, section, item)
""")
def lookup_exists(spark, sf):
    return lookup.existing(B.asked_refs(spark, sf), B.passages(spark, sf)).select("ref_id")


@query(f"""
WITH {B.PASSAGES}, {B.ASKED} SELECT ref_id FROM asked ANTI JOIN passages USING (edition, work, section, item)
""")
def lookup_missing(spark, sf):
    return lookup.missing(B.asked_refs(spark, sf), B.passages(spark, sf)).select("ref_id")


_EDITIONS = "editions AS (SELECT work, section, item, string_agg(edition, ',' ORDER BY edition) AS editions FROM passages GROUP BY ALL)"


def _joined(col):
    return F.array_join(F.coalesce(col, F.array().cast("array<string>")), ",")


@query(f"""
WITH {B.PASSAGES}, {B.ASKED}, {_EDITIONS},
m AS (SELECT a.*, p.edition AS found_edition, p.text AS passage_text,
  row_number() OVER (PARTITION BY ref_id ORDER BY CASE WHEN p.edition = a.edition THEN 0 WHEN p.edition = 'NKJV' THEN 1 ELSE 2 END, p.edition) AS r
  FROM asked a LEFT JOIN passages p USING (work, section, item))
SELECT ref_id, m.edition, work, section, item, found_edition, passage_text, coalesce(editions, '') AS available
FROM m LEFT JOIN editions USING (work, section, item) WHERE r = 1
""")
def edition_fallback(spark, sf):
    df = lookup.with_fallback(B.asked_refs(spark, sf), B.passages(spark, sf), "ref_id")
    return df.withColumn("available", _joined(F.col("available")))


@query(f"WITH {B.PASSAGES}, {_EDITIONS} SELECT * FROM editions")
def editions_per_reference(spark, sf):
    df = lookup.editions_per_reference(B.passages(spark, sf))
    return df.withColumn("editions", _joined(F.col("editions")))


@query(f"""
WITH {B.PASSAGES} SELECT work, section, item,
  string_agg(edition || '=' || text, '|' ORDER BY edition) AS texts FROM passages GROUP BY ALL
""")
def texts_per_reference(spark, sf):
    df = lookup.texts_per_reference(B.passages(spark, sf))
    pairs = F.transform(F.map_entries("texts"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return df.withColumn("texts", F.array_join(pairs, "|"))


@query(f"""
WITH {B.PASSAGES} SELECT work, section, item, max(text) FILTER (edition = 'AMP') AS "AMP",
  max(text) FILTER (edition = 'NKJV') AS "NKJV" FROM passages GROUP BY ALL
""")
def pivot_editions(spark, sf):
    return lookup.pivot_editions(B.passages(spark, sf), ["AMP", "NKJV"])


@query(f"WITH {B.PASSAGES} SELECT work, section, max(item) AS max_item FROM passages GROUP BY ALL")
def max_item(spark, sf):
    return lookup.max_item(B.passages(spark, sf))


@query(f"WITH {B.PASSAGES} SELECT work, max(section) AS max_section FROM passages GROUP BY ALL")
def max_section(spark, sf):
    return lookup.max_section(B.passages(spark, sf))


@query(f"""
WITH {B.PASSAGES}, {B.ASKED},
own AS (SELECT ref_id, a.edition, work, section, p.item, p.text FROM (SELECT ref_id, edition, work, section FROM asked) a
        JOIN passages p USING (edition, work, section)),
fb AS (SELECT ref_id, p.edition, work, section, p.item, p.text FROM (SELECT ref_id, work, section FROM asked WHERE ref_id NOT IN (SELECT ref_id FROM own)) a
       JOIN passages p USING (work, section) WHERE p.edition = 'NKJV')
SELECT ref_id, edition, work, section, item, text FROM own UNION ALL SELECT ref_id, edition, work, section, item, text FROM fb
""")
def section_reader(spark, sf):
    asked = B.asked_refs(spark, sf).drop("item")
    return lookup.read_sections(asked, B.passages(spark, sf)).select(
        "ref_id", "edition", "work", "section", "item", "text"
    ).orderBy("ref_id", "item")


def _dim(table: dict[str, str], name: str) -> str:
    rows = ", ".join(f"({B.lit(k)}, {B.lit(v)})" for k, v in sorted(table.items()))
    return f"{name}(alias, target) AS (VALUES {rows})"


_SCRUB = r"trim(regexp_replace(lower(trim({x})), '[^\p{{L}}\p{{N}}\s]', '', 'g'))"
_SQUASH = r"regexp_replace(lower(trim({x})), '[^\p{{L}}\p{{N}}]', '', 'g')"


def _sql_resolve(x: str) -> str:
    return (
        f"coalesce((SELECT target FROM wa WHERE alias = lower(trim({x}))), "
        f"(SELECT target FROM wa WHERE alias = {_SCRUB.format(x=x)}), "
        f"(SELECT target FROM wa WHERE alias = {_SQUASH.format(x=x)}))"
    )


def _alias_rows(spark, sf):
    """A spoken form per document: an alias in upper case, with punctuation or spaced out."""
    d = F.col("doc_id")
    alias = B.pick(B.WORK_ALIAS_POOL, d)
    spoken = (
        F.when(F.col("n_chars") % 4 == 0, F.upper(alias))
        .when(F.col("n_chars") % 4 == 1, F.concat(alias, F.lit(".")))
        .when(F.col("n_chars") % 4 == 2, F.concat(F.lit(" "), alias, F.lit(" ")))
        .otherwise(F.concat(F.lit("the "), alias))
    )
    return B.table(spark, sf, "documents").select(
        "doc_id", spoken.alias("spoken"), B.pick([*B.ALIAS_POOL, "Unknown", "Nkjv "], d).alias("edition_name")
    )


@query(f"""
WITH {_dim(L.work_aliases(), "wa")},
a AS (SELECT doc_id, {B.sql_pick(B.WORK_ALIAS_POOL, "doc_id")} AS alias0, n_chars FROM documents),
s AS (SELECT doc_id, CASE n_chars % 4 WHEN 0 THEN upper(alias0) WHEN 1 THEN alias0 || '.' WHEN 2 THEN ' ' || alias0 || ' ' ELSE 'the ' || alias0 END AS spoken FROM a)
SELECT doc_id, spoken, {_sql_resolve('spoken')} AS work FROM s
""")
def resolve_work_alias(spark, sf):
    return R.resolve_works(_alias_rows(spark, sf), "spoken", "work").select("doc_id", "spoken", "work")


_EDITION_DIM = {**{k.lower(): v for k, v in L.EDITION_CODES.items()}, **L.EDITION_ALIASES}


@query(f"""
WITH {_dim(_EDITION_DIM, "ea")},
s AS (SELECT doc_id, {B.sql_pick([*B.ALIAS_POOL, "Unknown", "Nkjv "], "doc_id")} AS edition_name FROM documents)
SELECT doc_id, edition_name, (SELECT target FROM ea WHERE alias = lower(trim(edition_name))) AS code,
  coalesce((SELECT target FROM (VALUES {", ".join(f"({B.lit(k)}, {B.lit(v)})" for k, v in L.EDITION_CODES.items())}) c(k, target)
            WHERE k = upper(trim(edition_name))), nullif(upper(trim(edition_name)), ''), 'UNK') AS normal_code
FROM s
""")
def resolve_edition_alias(spark, sf):
    return _alias_rows(spark, sf).select(
        "doc_id", "edition_name", R.resolve_edition(F.col("edition_name")).alias("code"),
        T.edition_code(F.col("edition_name")).alias("normal_code"),
    )


_SPOKEN = L.SPOKEN_REF_PATTERN
_SPOKEN_RE2 = B.lit("(?i)" + B.START + _SPOKEN[len(r"(?i)\b"):-2] + B.END)
_STRING_RE2 = B.lit("(?i)" + B.START + L.STRING_REF_PATTERN[len(r"(?i)\b"):-2] + B.END)
_PARSED = f"""
parsed AS (SELECT *, nullif(regexp_extract(text, {_SPOKEN_RE2}, 1), '') AS ref_token,
  nullif(regexp_extract(text, {_SPOKEN_RE2}, 2), '')::INTEGER AS ref_section,
  nullif(regexp_extract(text, {_SPOKEN_RE2}, 3), '')::INTEGER AS ref_item FROM utterances)"""


@query(f"""
WITH {_dim(L.work_aliases(), "wa")}, {B.UTTERANCES}, {_PARSED}
SELECT utt_id, ref_token, ref_section, ref_item,
  nullif(regexp_extract(text, {_STRING_RE2}, 1), '') AS str_token,
  CASE WHEN ref_token IS NOT NULL THEN {_sql_resolve('ref_token')} END AS work
FROM parsed
""")
def parse_reference(spark, sf):
    df = B.utterances(spark, sf)
    df = df.withColumns(R.spoken_reference(F.col("text")))
    df = df.withColumn("str_token", R.string_reference(F.col("text"))["ref_token"])
    return R.resolve_works(df, "ref_token", "work").select(
        "utt_id", "ref_token", "ref_section", "ref_item", "str_token", "work"
    )


def _any(phrases, x="low"):
    return f"regexp_matches({x}, {B.lit(L.either(phrases))})"


def _swap_sql(templates) -> str:
    parts = []
    for t in templates:
        body = B.START + "(?:" + t.replace("{e}", L.EDITION_ALTERNATION)[2:-2] + ")" + B.END
        alias = f"nullif(regexp_extract(low0, {B.lit(body)}, 1), '')"
        parts.append(f"(SELECT target FROM ea WHERE alias = {alias})")
    return "coalesce(" + ", ".join(parts) + ")"


_ROUTED = f"""
{_dim(_EDITION_DIM, "ea")}, {_dim(L.work_aliases(), "wa")}, {B.UTTERANCES}, {_PARSED},
lowered AS (SELECT *, lower(text) AS low0, {B.sql_trim('lower(text)')} AS low,
  len({B.sql_words('text')}) AS n_words FROM parsed),
swaps AS (SELECT *, {_swap_sql(L.SWAP_TEMPLATES)} AS named,
  CASE WHEN n_words <= 6 THEN {_swap_sql([L.SWAP_BROAD])} END AS broad FROM lowered),
acts AS (SELECT *, coalesce(named, broad) AS swap0,
  CASE WHEN a_edition IS NULL AND coalesce(named, broad) IS NOT NULL THEN 'swap_translation'
       WHEN {_any(L.NAV_NEXT_ITEM)} THEN 'next_verse' WHEN {_any(L.NAV_PREV_ITEM)} THEN 'prev_verse'
       WHEN {_any(L.NAV_NEXT_SECTION)} THEN 'next_chapter' WHEN {_any(L.NAV_PREV_SECTION)} THEN 'prev_chapter'
       WHEN coalesce(named, broad) IS NOT NULL THEN 'swap_translation' END AS action0 FROM swaps),
intents AS (SELECT *, CASE WHEN ref_item IS NOT NULL THEN 'EXPLICIT_REF'
       WHEN {_any(L.CLEAR_PHRASES)} AND n_words <= 8 THEN 'CLEAR_COMMAND'
       WHEN action0 IS NOT NULL THEN 'NAV_COMMAND' ELSE 'CUE_PHRASE' END AS intent FROM acts),
routed AS (SELECT *, CASE WHEN intent = 'NAV_COMMAND' THEN action0 END AS action,
       CASE WHEN intent = 'NAV_COMMAND' THEN swap0 END AS swap FROM intents)"""


@query(f"WITH {_ROUTED} SELECT utt_id, intent, action, swap FROM routed")
def intent_route(spark, sf):
    return router.classify(B.utterances(spark, sf), "text").select("utt_id", "intent", "action", "swap")


_STEP = """
mi AS (SELECT work, section, max(item) AS mx FROM passages GROUP BY ALL),
ms AS (SELECT work, max(section) AS ms FROM passages GROUP BY ALL),
nav AS (SELECT r.*, coalesce(h.mx, 0) AS here, b.mx AS before, coalesce(ms.ms, 0) AS last_section
  FROM routed r LEFT JOIN mi h ON h.work = a_work AND h.section = a_section
  LEFT JOIN mi b ON b.work = a_work AND b.section = a_section - 1
  LEFT JOIN ms ON ms.work = a_work WHERE intent = 'NAV_COMMAND'),
target AS (SELECT *, CASE action
    WHEN 'next_verse' THEN CASE WHEN a_item + 1 <= here THEN a_section WHEN a_section + 1 <= last_section THEN a_section + 1 END
    WHEN 'prev_verse' THEN CASE WHEN a_item > 1 THEN a_section WHEN a_section > 1 AND before IS NOT NULL THEN a_section - 1 END
    WHEN 'next_chapter' THEN CASE WHEN a_section + 1 <= last_section THEN a_section + 1 END
    WHEN 'prev_chapter' THEN CASE WHEN a_section > 1 AND before IS NOT NULL THEN a_section - 1 END
    ELSE a_section END AS ts,
  CASE action
    WHEN 'next_verse' THEN CASE WHEN a_item + 1 <= here THEN a_item + 1 WHEN a_section + 1 <= last_section THEN 1 END
    WHEN 'prev_verse' THEN CASE WHEN a_item > 1 THEN a_item - 1 WHEN a_section > 1 AND before IS NOT NULL THEN before END
    WHEN 'next_chapter' THEN CASE WHEN a_section + 1 <= last_section THEN 1 END
    WHEN 'prev_chapter' THEN CASE WHEN a_section > 1 AND before IS NOT NULL THEN before END
    ELSE a_item END AS ti,
  CASE WHEN action = 'swap_translation' THEN swap ELSE a_edition END AS te FROM nav),
stepped AS (SELECT t.*, p.edition AS fe, p.text AS ft, row_number() OVER (PARTITION BY utt_id ORDER BY
    CASE WHEN p.edition = te THEN 0 ELSE 2 END, p.edition) AS r
  FROM target t LEFT JOIN passages p ON p.work = a_work AND p.section = ts AND p.item = ti)"""


@query(f"""
WITH {B.PASSAGES}, {_ROUTED}, {_STEP},
hit AS (SELECT *, CASE WHEN action = 'swap_translation' AND fe <> te THEN NULL ELSE fe END AS h FROM stepped WHERE r = 1),
nav_out AS (SELECT utt_id, intent, action, h AS edition, CASE WHEN h IS NOT NULL THEN a_work END AS work,
  CASE WHEN h IS NOT NULL THEN ts END AS section, CASE WHEN h IS NOT NULL THEN ti END AS item,
  CASE WHEN h IS NOT NULL THEN ft END AS passage_text,
  CASE WHEN a_edition IS NULL THEN 'no anchor to navigate from' WHEN action = 'swap_translation' AND h IS NULL THEN 'edition not available'
       WHEN h IS NULL THEN 'out of range' END AS reason FROM hit),
ex AS (SELECT utt_id, ref_token, ref_section, ref_item, {_sql_resolve('ref_token')} AS work, coalesce(named, 'NKJV') AS want
  FROM routed WHERE intent = 'EXPLICIT_REF'),
exm AS (SELECT ex.*, p.edition AS fe, p.text AS ft, row_number() OVER (PARTITION BY utt_id ORDER BY
    CASE WHEN p.edition = want THEN 0 WHEN p.edition = 'NKJV' THEN 1 ELSE 2 END, p.edition) AS r
  FROM ex LEFT JOIN passages p ON p.work = ex.work AND p.section = ref_section AND p.item = ref_item),
ex_out AS (SELECT utt_id, 'EXPLICIT_REF' AS intent, NULL AS action, coalesce(fe, want) AS edition, work, ref_section AS section,
  ref_item AS item, ft AS passage_text, CASE WHEN work IS NULL THEN 'unknown work: ' || ref_token WHEN fe IS NULL THEN 'reference out of range' END AS reason
  FROM exm WHERE r = 1)
SELECT * FROM nav_out UNION ALL SELECT * FROM ex_out
UNION ALL SELECT utt_id, intent, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM routed WHERE intent IN ('CLEAR_COMMAND', 'CUE_PHRASE')
""")
def route_utterances(spark, sf):
    return router.route(B.utterances(spark, sf), B.passages(spark, sf)).drop("available")
