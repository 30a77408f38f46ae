"""Batch forms of the live operators and the activation audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicons as L
from ..operators import activation, live, navigation, records
from ..sources import transcripts
from . import bindings as B
from .bindings import query

R4 = B.sql_round


@query("""
SELECT user_id, time_bucket(INTERVAL 3600 SECONDS, ts, TIMESTAMP '1970-01-01') AS chunk_start,
  time_bucket(INTERVAL 3600 SECONDS, ts, TIMESTAMP '1970-01-01') + INTERVAL 3600 SECONDS AS chunk_end, count(*) AS n FROM events GROUP BY ALL
""")
def chunk_tumbling(spark, sf):
    return live.chunk_counts(B.table(spark, sf, "events"), ["user_id"], "ts", 3600.0)


@query("""
WITH e AS (SELECT user_id, ts, time_bucket(INTERVAL 8 SECONDS, ts, TIMESTAMP '1970-01-01') AS b FROM events),
w AS (SELECT user_id, b - INTERVAL 2 SECONDS AS s FROM e
  UNION ALL SELECT user_id, b + INTERVAL 6 SECONDS FROM e WHERE ts >= b + INTERVAL 6 SECONDS)
SELECT user_id, s AS chunk_start, s + INTERVAL 10 SECONDS AS chunk_end, count(*) AS n FROM w GROUP BY ALL
""")
def chunk_sliding(spark, sf):
    """Eight new seconds preceded by two seconds of overlap."""
    return live.chunk_counts(B.table(spark, sf, "events"), ["user_id"], "ts", 8.0, 2.0)


@query(f"""
WITH {B.LIVE_LOG}
SELECT kind, time_bucket(INTERVAL 86400 SECONDS, ts, TIMESTAMP '1970-01-01') AS chunk_start, count(*) AS n, {R4('sum(value)', 3)} AS busy, {R4('sum(item)', 3)} AS total,
  coalesce(sum(value) / nullif(sum(item), 0), 0) > 0.95 AS lagging FROM log GROUP BY ALL
""")
def progress_metrics(spark, sf):
    df = live.progress_metrics(B.live_log(spark, sf), ["kind"], "ts", "value", "item", 86400.0)
    return df.withColumns({c: records.round_at(F.col(c), 3) for c in ("busy", "total")})


@query(f"""
WITH {B.LIVE_LOG} SELECT kind AS stage, count(*) AS n, {R4('avg(value)', 5)} AS avg_busy, {R4('sum(value) / sum(item)', 5)} AS ratio FROM log GROUP BY ALL
""")
def stage_metrics(spark, sf):
    df = live.stage_metrics(B.live_log(spark, sf), "kind", "value", "item")
    return df.withColumns({c: records.round_at(F.col(c), 5) for c in ("avg_busy", "ratio")})


@query(f"""
WITH {B.LIVE_LOG},
a AS (SELECT *, epoch_us(ts) / 1e6 AS at_s FROM log),
f AS (SELECT *, CASE WHEN at_s - lag(at_s) OVER w < 7200 THEN 0 ELSE 1 END AS fresh FROM a WINDOW w AS (PARTITION BY stream_id ORDER BY seq)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY stream_id ORDER BY seq)::BIGINT AS utterance FROM f)
SELECT stream_id, utterance, min(at_s) AS start_time, max(at_s) AS end_time, count(*) AS n_updates, arg_max(kind, seq) AS text FROM g GROUP BY ALL
""")
def utterance_islands(spark, sf):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return live.utterance_islands(B.live_log(spark, sf), "stream_id", "seq", at, "kind", gap=7200.0)


def _routed_turns(spark, sf):
    return _routed_turns_of(B.table(spark, sf, "conversations"))


def _routed_turns_of(conversations):
    """Turns with quotation phrases, some without their end mark, and commands after some of them."""
    seg = B.cue_segments_of(B.segments_of(conversations))
    n = F.col("stream_id") + F.col("seg_id") * 3
    text = F.when(n % 2 == 0, F.regexp_replace("text", r"[.!?]+\s*$", "")).otherwise(F.col("text"))
    said = F.when(n % 11 == 0, F.array(text, F.lit("next verse"))).otherwise(F.array(text))
    turns = seg.select("stream_id", "seg_id", F.posexplode(said).alias("half", "text"))
    return turns.select("stream_id", (F.col("seg_id") * 2 + F.col("half")).alias("seg_id"), "text")


_SPOKEN_RE2 = B.lit("(?i)" + B.START + L.SPOKEN_REF_PATTERN[len(r"(?i)\b"):-2] + B.END)
_OPENER = B.lit(L.QUOTE_OPENER_PATTERN[:-2] + B.END)


ACCUMULATED = rf"""
WITH RECURSIVE {B.CUE_SEGMENTS},
tx AS (SELECT stream_id, seg_id * 2 AS seg_id, CASE WHEN (stream_id + seg_id * 3) % 2 = 0 THEN regexp_replace(text, '[.!?]+\s*$', '') ELSE text END AS text FROM cue_segments
  UNION ALL SELECT stream_id, seg_id * 2 + 1, 'next verse' FROM cue_segments WHERE (stream_id + seg_id * 3) % 11 = 0),
cl AS (SELECT *, text = 'next verse' OR regexp_matches(text, {_SPOKEN_RE2}) AS other, regexp_matches(text, '[.!?][''"]?\s*$') AS fin,
  regexp_matches(lower(text), {_OPENER}) AS opener, len({B.sql_words('text')}) AS nw FROM tx),
rel AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY seg_id) AS r FROM cl WHERE other OR nw >= 3),
f AS (
  SELECT stream_id, r, seg_id, CASE WHEN other THEN NULL ELSE text END AS acc, other, (NOT other)::BIGINT AS quote_no, seg_id AS first_seq, fin, 1 AS n_parts FROM rel WHERE r = 1
  UNION ALL
  SELECT rel.stream_id, rel.r, rel.seg_id,
    CASE WHEN rel.other THEN NULL WHEN f.other OR f.fin OR rel.opener THEN rel.text
      WHEN contains(f.acc, rel.text) OR contains(rel.text, f.acc) THEN rel.text ELSE f.acc || ' ' || rel.text END,
    rel.other, f.quote_no + CASE WHEN NOT rel.other AND (f.other OR f.fin OR rel.opener) THEN 1 ELSE 0 END,
    CASE WHEN rel.other OR f.other OR f.fin OR rel.opener THEN rel.seg_id ELSE f.first_seq END, rel.fin,
    CASE WHEN rel.other OR f.other OR f.fin OR rel.opener THEN 1 ELSE f.n_parts + 1 END
  FROM rel JOIN f ON rel.stream_id = f.stream_id AND rel.r = f.r + 1),
l AS (SELECT * FROM f WHERE NOT other QUALIFY row_number() OVER (PARTITION BY stream_id, quote_no ORDER BY r DESC) = 1)"""


@query(ACCUMULATED + """
SELECT stream_id, quote_no, first_seq, seg_id AS last_seq, acc AS candidate_text, n_parts::INTEGER AS n_parts FROM l
""")
def cue_accumulation(spark, sf):
    return live.accumulate_cues(_routed_turns(spark, sf), "stream_id", "seg_id")


@query(f"""
WITH {B.LIVE_LOG}
SELECT seq, kind, last_value(CASE WHEN kind = 'present' THEN item END IGNORE NULLS) OVER
  (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor FROM log
""")
def asof_anchor(spark, sf):
    log = B.live_log(spark, sf)
    df = live.as_of_anchor(log, "stream_id", "seq", F.col("kind") == "present", F.col("item"))
    return df.select("seq", "kind", "anchor")


_ACTIONS = ["show", "next_verse", "next_verse", "prev_verse", "next_chapter", "prev_chapter", "swap_translation"]
_ASKED = ["AMP", "NKJV", "KJV"]


def _commands(spark, sf):
    """A command per turn that depends on its text: references, steps, swaps, and turns without any."""
    n, turn = F.length("text"), F.col("conv_id") + F.col("turn")
    action = F.get(F.array(*map(F.lit, [*_ACTIONS, None])), n % (len(_ACTIONS) + 1))
    return B.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), action.alias("action"),
        B.pick(_ASKED, n).alias("edition"), B.pick(B.WORK_POOL, turn).alias("work"),
        (n % 3 + 1).cast("int").alias("section"), (n % 6 + 1).cast("int").alias("item"),
    )


@query(f"""
WITH RECURSIVE {B.PASSAGES},
byref AS (SELECT work, section, item, list_sort(list(edition)) AS eds FROM passages GROUP BY ALL),
refs AS (SELECT *, row_number() OVER (PARTITION BY work ORDER BY section, item) AS o, dense_rank() OVER (PARTITION BY work ORDER BY section) AS k FROM byref),
secs AS (SELECT work, k, min(o) AS lo, max(o) AS hi FROM refs GROUP BY ALL),
goals AS (SELECT work, o, 'next_verse' AS action, o + 1 AS t FROM refs UNION ALL SELECT work, o, 'prev_verse', o - 1 FROM refs
  UNION ALL SELECT work, o, 'swap_translation', o FROM refs
  UNION ALL SELECT r.work, o, 'next_chapter', lo FROM refs r JOIN secs s ON s.work = r.work AND s.k = r.k + 1
  UNION ALL SELECT r.work, o, 'prev_chapter', hi FROM refs r JOIN secs s ON s.work = r.work AND s.k = r.k - 1),
leads AS (SELECT g.work, g.o AS from_o, g.action, r.o AS to_o, r.eds FROM goals g JOIN refs r ON r.work = g.work AND r.o = g.t),
said AS (SELECT conv_id, turn, {B.sql_list(_ACTIONS)}[length(text) % {len(_ACTIONS) + 1} + 1] AS action, {B.sql_pick(_ASKED, "length(text)")} AS edition,
  {B.sql_pick(B.WORK_POOL, "conv_id + turn")} AS work, (length(text) % 3 + 1)::INTEGER AS section, (length(text) % 6 + 1)::INTEGER AS item FROM conversations),
ev AS MATERIALIZED (SELECT s.*, r.o AS show_o, CASE WHEN list_contains(r.eds, edition) THEN edition WHEN list_contains(r.eds, 'NKJV') THEN 'NKJV' ELSE r.eds[1] END AS show_e,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM said s LEFT JOIN refs r USING (work, section, item)),
f AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS rn, NULL::BIGINT AS turn, NULL::VARCHAR AS e, NULL::VARCHAR AS w, NULL::BIGINT AS o, NULL::VARCHAR AS reason FROM ev
  UNION ALL
  SELECT conv_id, rn, turn, CASE WHEN ok THEN ne ELSE e END, CASE WHEN ok THEN nw ELSE w END, CASE WHEN ok THEN no ELSE o END,
    CASE WHEN ok OR action IS NULL THEN NULL WHEN action = 'show' THEN 'reference out of range' WHEN e IS NULL THEN 'no anchor to navigate from'
      WHEN action = 'swap_translation' THEN 'edition not available' ELSE 'out of range' END
  FROM (SELECT *, ne IS NOT NULL AS ok FROM (
    SELECT x.conv_id, x.rn, x.turn, x.action, f.e, f.w, f.o, CASE WHEN x.action = 'show' THEN x.work ELSE f.w END AS nw,
      CASE WHEN x.action = 'show' THEN x.show_o ELSE g.to_o END AS no,
      CASE WHEN x.action = 'show' THEN x.show_e WHEN x.action = 'swap_translation' THEN CASE WHEN list_contains(g.eds, x.edition) THEN x.edition END
        WHEN list_contains(g.eds, f.e) THEN f.e ELSE g.eds[1] END AS ne
    FROM f JOIN ev x ON x.conv_id = f.conv_id AND x.rn = f.rn + 1
      LEFT JOIN leads g ON g.work = f.w AND g.from_o = f.o AND g.action = x.action)))
SELECT conv_id AS stream_id, turn AS seq, e AS to_edition, w AS to_work, section AS to_section, item AS to_item, reason
FROM f LEFT JOIN refs ON refs.work = f.w AND refs.o = f.o WHERE rn > 0
""")
def nav_chain(spark, sf):
    chain = navigation.nav_chain(_commands(spark, sf), B.passages(spark, sf))
    return chain.select("stream_id", "seq", "to_edition", "to_work", "to_section", "to_item", "reason")


_MODE = "CASE WHEN kind = 'mode' THEN CASE item % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'autopilot' ELSE 'semi_autopilot' END END"


MODE_GATE = f"""
WITH {B.LIVE_LOG}, m AS (SELECT *, coalesce(last_value({_MODE} IGNORE NULLS) OVER
  (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'semi_autopilot') AS mode FROM log)
SELECT seq, mode, mode <> 'manual' AS accepted, mode = 'autopilot' AND kind = 'present' AND confidence >= 0.6 AS presented FROM m
"""


def mode_named():
    name = F.when(F.col("item") % 3 == 0, "manual").when(F.col("item") % 3 == 1, "autopilot").otherwise("semi_autopilot")
    return F.when(F.col("kind") == "mode", name)


@query(MODE_GATE)
def mode_gate(spark, sf):
    log = B.live_log(spark, sf).withColumn("is_final", F.col("kind") == "present")
    df = live.gate_by_mode(log, "stream_id", "seq", mode_named())
    return df.select("seq", "mode", "accepted", "presented")


DISPLAY_STATE = f"""
WITH {B.LIVE_LOG}, l AS (SELECT * FROM log WHERE kind IN ('present', 'clear') QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY seq DESC) = 1)
SELECT stream_id, seq AS as_of, CASE WHEN kind = 'present' THEN item END AS shown FROM l
"""


@query(DISPLAY_STATE)
def display_state(spark, sf):
    return live.display_state(B.live_log(spark, sf), "stream_id", "seq", "kind", "item")


@query(f"""
WITH {B.LIVE_LOG}
SELECT stream_id, item, seq FROM log a WHERE kind = 'queue_add'
  AND NOT EXISTS (SELECT 1 FROM log b WHERE b.stream_id = a.stream_id AND b.seq > a.seq AND (b.kind = 'queue_clear' OR (b.kind = 'queue_remove' AND b.item = a.item)))
""")
def queue_state(spark, sf):
    return live.queue_state(B.live_log(spark, sf), "stream_id", "seq", "kind", "item").select(
        "stream_id", "item", "seq"
    )


@query(f"""
WITH {B.LIVE_LOG} SELECT CASE WHEN kind = 'present' THEN 'detection' WHEN kind LIKE 'queue%' THEN 'queue_update' WHEN kind = 'clear' THEN 'display_update' ELSE 'transcript_update' END AS type,
  seq, CASE WHEN kind = 'present' THEN floor(confidence * 100 + 0.5)::INTEGER END AS percent FROM log
""")
def event_feed(spark, sf):
    log = B.live_log(spark, sf).select("seq", "kind", "confidence")
    kind = F.col("kind")
    feed = live.event_feed(
        log.filter(kind == "mode"), log.filter(kind == "present"), log.filter(kind == "clear"),
        log.filter(kind.startswith("queue")),
    )
    return feed.select(
        "type", F.get_json_object("payload", "$.seq").cast("long").alias("seq"),
        F.get_json_object("payload", "$.confidence_percent").cast("int").alias("percent"),
    )


def _messages(spark, sf):
    return _messages_of(B.table(spark, sf, "conversations"))


def _messages_of(conversations):
    """Recognition messages made of the turns, including empty, malformed and end messages."""
    n = F.col("conv_id") + F.col("turn")
    word = F.struct(
        F.lit("x").alias("word"), F.get(F.split("text", " "), 0).alias("punctuated_word"),
        F.lit(0.5).alias("start"), F.lit(0.75).alias("end"), F.lit(0.9).alias("confidence"),
    )
    alt = F.struct(
        F.when(n % 7 == 0, "  ").otherwise(F.col("text")).alias("transcript"),
        (n % 3 == 0).alias("speech_final"), F.array(word).alias("words"),
    )
    body = F.struct(
        F.when(n % 11 == 0, "UtteranceEnd").otherwise("Results").alias("type"), (n % 2 == 0).alias("is_final"),
        (F.col("turn") * 10.0).alias("start"), F.lit(2.5).alias("duration"),
        F.struct(F.array(alt).alias("alternatives")).alias("channel"),
    )
    payload = F.when(n % 13 == 0, F.concat(F.lit("{broken"), "text")).otherwise(F.to_json(body))
    return conversations.select("conv_id", "turn", payload.alias("payload"))


@query(rf"""
WITH m AS (SELECT *, conv_id + turn AS n FROM conversations WHERE (conv_id + turn) % 13 <> 0)
SELECT conv_id, turn, CASE WHEN n % 11 = 0 THEN 'UtteranceEnd' ELSE 'Results' END AS type,
  CASE WHEN n % 7 = 0 THEN '' ELSE {B.sql_trim('text')} END AS text, n % 2 = 0 AS is_final, n % 3 = 0 AS speech_final,
  turn * 10.0::DOUBLE AS start_time, turn * 10.0::DOUBLE + 2.5 AS end_time, string_split(text, ' ')[1] AS word
FROM m WHERE n % 11 = 0 OR n % 7 <> 0
""")
def parse_messages(spark, sf):
    df = transcripts.parse_messages(_messages(spark, sf))
    word = F.get("words", 0)["text"]
    return df.withColumn("word", word).drop("words")


# ---- activation log ------------------------------------------------------------------------------
def _activation_log(spark, sf):
    action = (
        F.when(F.col("event_type").isin("view", "signup"), "activate").when(F.col("event_type") == "click", "heartbeat")
        .when(F.col("event_type") == "error", "deactivate")
        .otherwise(F.when(F.col("value") > 300, "revoke").otherwise("heartbeat"))
    )
    k = F.get_json_object("props", "$.k").cast("int")
    return B.table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), "ts", F.concat(F.lit("key"), F.col("user_id").cast("string")).alias("license_key"),
        F.concat(F.lit("dev"), (k % 3).cast("string")).alias("fingerprint"), action.alias("action"),
    )


_ACT = """
al AS (SELECT event_id AS seq, ts, 'key' || user_id AS license_key, 'dev' || (json_extract_string(props, '$.k')::INTEGER % 3) AS fingerprint,
  CASE WHEN event_type IN ('view', 'signup') THEN 'activate' WHEN event_type = 'click' THEN 'heartbeat' WHEN event_type = 'error' THEN 'deactivate'
    WHEN value > 300 THEN 'revoke' ELSE 'heartbeat' END AS action, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
st AS (
  SELECT license_key, r, '' AS holder, CASE WHEN action = 'revoke' THEN '#' WHEN action = 'activate' THEN fingerprint ELSE '' END AS state FROM al WHERE r = 1
  UNION ALL
  SELECT al.license_key, al.r, st.state, CASE WHEN st.state = '#' OR al.action = 'revoke' THEN '#' WHEN al.action = 'activate' AND st.state = '' THEN al.fingerprint
    WHEN al.action = 'deactivate' AND st.state = al.fingerprint THEN '' ELSE st.state END
  FROM al JOIN st ON al.license_key = st.license_key AND al.r = st.r + 1),
oc AS (SELECT al.*, CASE WHEN holder = '#' THEN '' WHEN action = 'revoke' THEN '' ELSE holder END AS holder,
  CASE WHEN action = 'revoke' THEN 'revoked' WHEN holder = '#' THEN 'refused'
    WHEN action = 'activate' THEN CASE WHEN holder = '' THEN 'activated' WHEN holder = fingerprint THEN 'refreshed' ELSE 'conflict' END
    WHEN action = 'heartbeat' THEN CASE WHEN holder = fingerprint THEN 'seen' ELSE 'not_active' END
    ELSE CASE WHEN holder = fingerprint THEN 'released' ELSE 'not_active' END END AS outcome
  FROM al JOIN st USING (license_key, r))"""
_DEV = """
dv AS (SELECT license_key, fingerprint, min(ts) FILTER (outcome = 'activated') AS activated_at, max(ts) FILTER (outcome <> 'released') AS last_seen,
  max(ts) FILTER (outcome IN ('activated', 'refreshed')) + INTERVAL 21 DAYS AS token_expires_at, arg_max(outcome, seq) AS last_outcome
  FROM oc WHERE outcome IN ('activated', 'refreshed', 'seen', 'released') GROUP BY ALL),
rv AS (SELECT DISTINCT license_key FROM oc WHERE outcome = 'revoked'),
dev AS (SELECT license_key, fingerprint, activated_at, last_seen, token_expires_at,
  CASE WHEN last_outcome = 'released' OR license_key IN (SELECT license_key FROM rv) THEN 'deactivated' ELSE 'active' END AS status FROM dv)"""


@query(f"WITH RECURSIVE {_ACT.strip()} SELECT seq, license_key, fingerprint, holder, outcome FROM oc")
def activation_outcomes(spark, sf):
    return activation.activation_outcomes(_activation_log(spark, sf)).select(
        "seq", "license_key", "fingerprint", "holder", "outcome"
    )


@query(f"WITH RECURSIVE {_ACT.strip()}, {_DEV} SELECT * FROM dev")
def token_expiry(spark, sf):
    return activation.device_report(activation.activation_outcomes(_activation_log(spark, sf)))


@query(f"""
WITH RECURSIVE {_ACT.strip()}, {_DEV},
k AS (SELECT license_key, count(*) FILTER (outcome = 'conflict') AS n_conflicts, count(*) FILTER (outcome = 'revoked') AS nr FROM oc GROUP BY ALL),
d AS (SELECT license_key, string_agg(fingerprint || ':' || status, ',' ORDER BY fingerprint) AS devices, count(*) FILTER (status = 'active') AS na FROM dev GROUP BY ALL)
SELECT k.license_key, n_conflicts, coalesce(devices, '') AS devices, CASE WHEN nr > 0 THEN 'revoked' WHEN na > 0 THEN 'active' ELSE 'unactivated' END AS status
FROM k LEFT JOIN d USING (license_key)
""")
def activation_report(spark, sf):
    df = activation.license_report(activation.activation_outcomes(_activation_log(spark, sf)))
    names = F.transform("devices", lambda d: F.concat(d["fingerprint"], F.lit(":"), d["status"]))
    return df.withColumn("devices", F.coalesce(F.array_join(names, ","), F.lit("")))
