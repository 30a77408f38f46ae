"""How the driver tables play the roles of the library, once as DataFrames and once as SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicons as L

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

WORK_POOL = ["Genesis", "Exodus", "1 Samuel", "John"]
ALIAS_POOL = sorted(L.EDITION_ALIASES)
WORK_ALIAS_POOL = sorted(L.work_aliases())


def query(sql: str | None = None):
    """Register a query under its function name, with its SQL if there is one."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table. Text tables of fewer splits than there are cores are dealt to all of them."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in ("documents", "conversations") and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def pick(pool: list[str], index: Column) -> Column:
    """Element of a fixed list by row-derived position."""
    return F.get(F.array(*[F.lit(p) for p in pool]), (index % len(pool)).cast("int"))


# ---- SQL fragments ------------------------------------------------------------------------
def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(pool: list[str]) -> str:
    return "[" + ", ".join(lit(p) for p in pool) + "]"


def sql_pick(pool: list[str], index: str) -> str:
    return f"({sql_list(pool)})[(({index}) % {len(pool)}) + 1]"


START = r"(?:^|[^\p{L}\p{N}_])"
END = r"(?:$|[^\p{L}\p{N}_])"


def re2(pattern: str) -> str:
    """A predicate pattern with Unicode-aware word borders, as an SQL literal."""
    flag = ""
    if pattern.startswith("(?i)"):
        flag, pattern = "(?i)", pattern[4:]
    parts = re.sub(r"(^|(?<=\|))\\b", lambda m: START, pattern)
    return lit(flag + parts.replace(r"\b", END))


def sql_round(x: str, digits: int) -> str:
    return f"(floor(({x}) * 1e{digits} + 0.5::DOUBLE) / 1e{digits})"


def sql_words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def sql_trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sql_sentences(x: str) -> str:
    split = rf"string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({split}, lambda s: {sql_trim('s')}), lambda s: s <> '')"


def sql_tokens(x: str, stop: list[str]) -> str:
    found = f"regexp_extract_all(lower({x}), '[a-z'']+')"
    return f"list_filter({found}, lambda w: length(w) > 2 AND NOT list_contains({sql_list(stop)}, w))"


def sql_md5_bucket(w: str, dim: int = 384) -> str:
    step = (2**32) % dim
    acc = "0"
    for i in range(4):
        limb = f"('0x' || substr(md5({w}), {8 * i + 1}, 8))::BIGINT"
        acc = f"(({acc}) * {step} + {limb}) % {dim}"
    return acc


# ---- passages from benchmark -----------------------------------------------------------------
def passages(spark: SparkSession, sf: str) -> DataFrame:
    """Two editions: the text, and for texts with commas the text without them."""
    nr = F.floor(F.col("item_id") / len(WORK_POOL))
    base = table(spark, sf, "benchmark").select(
        "item_id", pick(WORK_POOL, F.col("item_id")).alias("work"),
        (F.floor(nr / 5) + 1).cast("int").alias("section"), (nr % 5 + 1).cast("int").alias("item"), "text",
    )
    cols = ["work", "section", "item", "text"]
    first = base.select(
        (F.col("item_id") * 2).alias("passage_id"), F.lit("AMP").alias("edition"), *cols
    )
    second = base.filter(F.contains("text", F.lit(","))).select(
        (F.col("item_id") * 2 + 1).alias("passage_id"), F.lit("NKJV").alias("edition"), *cols[:3],
        F.replace("text", F.lit(","), F.lit("")).alias("text"),
    )
    return first.unionByName(second)


PASSAGES = f"""base AS (
  SELECT item_id, {sql_pick(WORK_POOL, "item_id")} AS work,
         (item_id // 4 // 5 + 1)::INTEGER AS section, ((item_id // 4) % 5 + 1)::INTEGER AS item, text
  FROM benchmark),
passages AS (
  SELECT item_id * 2 AS passage_id, 'AMP' AS edition, work, section, item, text FROM base
  UNION ALL
  SELECT item_id * 2 + 1, 'NKJV', work, section, item, replace(text, ',', '')
  FROM base WHERE contains(text, ','))"""


# ---- segments from conversations ----------------------------------------------------------------
def segments(spark: SparkSession, sf: str) -> DataFrame:
    return segments_of(table(spark, sf, "conversations"))


def segments_of(conversations: DataFrame) -> DataFrame:
    start = F.col("turn") * 10.0
    return conversations.select(
        F.col("conv_id").alias("stream_id"), F.col("turn").alias("seg_id"), "text",
        start.alias("start_time"), (start + 10.0).alias("end_time"),
    )


SEGMENTS = """segments AS (
  SELECT conv_id AS stream_id, turn AS seg_id, text, turn * 10.0::DOUBLE AS start_time,
         turn * 10.0::DOUBLE + 10.0::DOUBLE AS end_time
  FROM conversations)"""


# ---- conversation turns with quotation phrases worked in ------------------------------------------
CUE_TEMPLATES = {
    0: ("The Bible says ", ""), 1: ("", " as Paul writes in Romans 8:28."), 2: ("", ""),
    3: ("In Romans we learn ", ""), 4: ("Read 3 : 16 again. ", " says the Lord"),
    5: ("the johnson family and ", ""),
}


def cue_segments(spark: SparkSession, sf: str) -> DataFrame:
    return cue_segments_of(segments(spark, sf))


def cue_segments_of(segs: DataFrame) -> DataFrame:
    """Every turn, with a spoken phrase in front or behind that depends on the row."""
    kind = (F.col("stream_id") + F.col("seg_id")) % len(CUE_TEMPLATES)
    text = F.col("text")
    expr = text
    for k, (pre, post) in CUE_TEMPLATES.items():
        expr = F.when(kind == k, F.concat(F.lit(pre), text, F.lit(post))).otherwise(expr)
    return segs.withColumn("text", expr)


_CUE_CASE = " ".join(
    f"WHEN {k} THEN {lit(pre)} || text || {lit(post)}" for k, (pre, post) in CUE_TEMPLATES.items()
)
CUE_SEGMENTS = f"""{SEGMENTS},
cue_segments AS (
  SELECT stream_id, seg_id, start_time, end_time,
         CASE (stream_id + seg_id) % {len(CUE_TEMPLATES)} {_CUE_CASE} END AS text
  FROM segments)"""


# ---- spoken commands and references from documents ------------------------------------------------
def utterances(spark: SparkSession, sf: str) -> DataFrame:
    """Two utterances per document: a reference or command, and the document's own text."""
    d = F.col("doc_id")
    work = pick(WORK_POOL, d)
    section, item = (d % 4 + 1).cast("string"), (d % 6 + 1).cast("string")
    edition = pick(ALIAS_POOL, d)
    kind = F.col("n_chars") % 10
    forms = [
        F.concat(F.lit("turn to "), work, F.lit(" "), section, F.lit(":"), item),
        F.concat(work, F.lit(" chapter "), section, F.lit(" verse "), item),
        F.concat(F.lower(work), F.lit(" "), section, F.lit(" "), item),
        F.lit("next verse"), F.lit("go back a verse please"), F.lit("next chapter"),
        F.lit("Previous chapter"), F.concat(F.lit("read it in the "), edition),
        F.concat(F.lit("now in "), edition), F.lit("Remove it."),
    ]
    spoken = forms[-1]
    for i, form in enumerate(forms[:-1]):
        spoken = F.when(kind == i, form).otherwise(spoken)
    said = F.concat(F.when(F.col("n_chars") % 2 == 0, "the bible says ").otherwise(""), F.col("text"))
    anchored = F.col("lang") != "es"
    return table(spark, sf, "documents").select(
        d, "source", F.posexplode(F.array(spoken, said)).alias("half", "text"),
        F.when(anchored, pick(["AMP", "NKJV"], d)).alias("a_edition"),
        F.when(anchored, pick(WORK_POOL, d + 1)).alias("a_work"),
        F.when(anchored, (d % 3 + 1).cast("int")).alias("a_section"),
        F.when(anchored, (d % 5 + 1).cast("int")).alias("a_item"),
    ).withColumn("utt_id", d * 2 + F.col("half")).drop("doc_id", "half")


UTTERANCES = f"""raw_utt AS (
  SELECT doc_id, source, text AS doc_text, lang, n_chars, half, n_chars % 10 AS kind,
         {sql_pick(WORK_POOL, "doc_id")} AS w, (doc_id % 4 + 1)::VARCHAR AS s,
         (doc_id % 6 + 1)::VARCHAR AS i, {sql_pick(ALIAS_POOL, "doc_id")} AS e
  FROM documents CROSS JOIN (VALUES (0), (1)) h(half)),
utterances AS (
  SELECT doc_id * 2 + half AS utt_id, source, CASE WHEN half = 1 THEN CASE WHEN n_chars % 2 = 0 THEN 'the bible says ' ELSE '' END || doc_text ELSE CASE kind
    WHEN 0 THEN 'turn to ' || w || ' ' || s || ':' || i
    WHEN 1 THEN w || ' chapter ' || s || ' verse ' || i
    WHEN 2 THEN lower(w) || ' ' || s || ' ' || i
    WHEN 3 THEN 'next verse' WHEN 4 THEN 'go back a verse please' WHEN 5 THEN 'next chapter'
    WHEN 6 THEN 'Previous chapter' WHEN 7 THEN 'read it in the ' || e WHEN 8 THEN 'now in ' || e
    WHEN 9 THEN 'Remove it.' END END AS text,
    CASE WHEN lang <> 'es' THEN {sql_pick(["AMP", "NKJV"], "doc_id")} END AS a_edition,
    CASE WHEN lang <> 'es' THEN {sql_pick(WORK_POOL, "doc_id + 1")} END AS a_work,
    CASE WHEN lang <> 'es' THEN (doc_id % 3 + 1)::INTEGER END AS a_section,
    CASE WHEN lang <> 'es' THEN (doc_id % 5 + 1)::INTEGER END AS a_item
  FROM raw_utt)"""


# ---- references asked for, from documents ------------------------------------------------------------
def asked_refs(spark: SparkSession, sf: str) -> DataFrame:
    d, n = F.col("doc_id"), F.col("n_chars")
    return table(spark, sf, "documents").select(
        d.alias("ref_id"), pick(["AMP", "NKJV", "KJV"], d).alias("edition"),
        pick(WORK_POOL, d).alias("work"), (n % 4 + 1).cast("int").alias("section"),
        (n % 6 + 1).cast("int").alias("item"),
    )


ASKED = f"""asked AS (
  SELECT doc_id AS ref_id, {sql_pick(["AMP", "NKJV", "KJV"], "doc_id")} AS edition,
         {sql_pick(WORK_POOL, "doc_id")} AS work, (n_chars % 4 + 1)::INTEGER AS section,
         (n_chars % 6 + 1)::INTEGER AS item
  FROM documents)"""


# ---- live log from events -----------------------------------------------------------------------------
KINDS = {
    "view": "present", "click": "mode", "purchase": "queue_add", "error": "clear", "signup": "queue_remove",
}


def live_log(spark: SparkSession, sf: str) -> DataFrame:
    return live_log_of(table(spark, sf, "events"))


def live_log_of(events: DataFrame) -> DataFrame:
    """stream = user, seq = event id, item = k of the properties."""
    item = F.get_json_object("props", "$.k").cast("int")
    kind = F.lit(None).cast("string")
    for raw, name in KINDS.items():
        kind = F.when(F.col("event_type") == raw, name).otherwise(kind)
    kind = F.when((kind == "clear") & (item % 2 == 0), "queue_clear").otherwise(kind)
    return events.select(
        F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), "ts", kind.alias("kind"),
        item.alias("item"), "value", F.least(F.col("value") / 200, F.lit(1.0)).alias("confidence"),
    )


_KIND_CASE = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in KINDS.items())
LIVE_LOG = f"""log0 AS (
  SELECT user_id AS stream_id, event_id AS seq, ts, CASE event_type {_KIND_CASE} END AS kind0,
         json_extract_string(props, '$.k')::INTEGER AS item, value,
         least(value / 200, 1.0::DOUBLE) AS confidence
  FROM events),
log AS (
  SELECT stream_id, seq, ts, item, value, confidence,
         CASE WHEN kind0 = 'clear' AND item % 2 = 0 THEN 'queue_clear' ELSE kind0 END AS kind
  FROM log0)"""


# ---- hashed bag of words in SQL --------------------------------------------------------------------------
def bow_ctes(name: str, source: str, keys: str, text: str, prefix: bool) -> str:
    """CTEs `<name>_bow(keys, dim, w)` with unit-length sparse vectors."""
    from .. import config as C

    body = f"{lit(C.QUERY_PREFIX + ' ')} || {text}" if prefix else text
    return f"""{name}_w AS (
  SELECT {keys}, unnest(regexp_extract_all(lower({body}), '[a-z'']+')) AS word FROM {source}),
{name}_d AS (
  SELECT {keys}, {sql_md5_bucket("word")} AS dim, count(*)::DOUBLE AS c
  FROM {name}_w WHERE length(word) > 2 GROUP BY ALL),
{name}_n AS (SELECT {keys}, sqrt(sum(c * c)) AS norm FROM {name}_d GROUP BY ALL),
{name}_bow AS (SELECT {keys}, dim, c / norm AS w FROM {name}_d JOIN {name}_n USING ({keys}))"""
