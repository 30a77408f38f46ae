"""Streams fed in several files, in any order, end with the same rows as one pass over all events."""

import random

import pytest
from pyspark.sql import functions as F

from quotelake.streaming import jobs, sources, stateful


def _feed(spark, tmp_path, rows, schema, parts=3, shuffled=False):
    """Write rows with a time per `seq` as files, then one far ahead that moves the watermark."""
    path = str(tmp_path / "in")
    at = F.timestamp_seconds(F.lit(1_000_000) + F.col("seq")).alias("event_time")
    rows = random.Random(3).sample(rows, len(rows)) if shuffled else rows
    for i in range(parts):
        part = rows[i * len(rows) // parts:(i + 1) * len(rows) // parts]
        frame = spark.createDataFrame(part, schema)
        frame.withColumn("event_time", at).coalesce(1).write.mode("append").json(path)
    width = len(schema.split(", "))
    end = spark.createDataFrame([("~", 0, *[None] * (width - 2))], schema)
    end.withColumn("event_time", F.timestamp_seconds(F.lit(2_000_000))).coalesce(1).write.mode("append").json(path)
    return path


def _events(spark, path, schema, lateness="1 hour"):
    timed = schema if "event_time" in schema else schema + ", event_time timestamp"
    return sources.read_events(spark, path, timed, files_per_trigger=1, lateness=lateness)


def _run(df, tmp_path, name):
    q = jobs.run(df, name, jobs.once_per_epoch(str(tmp_path / "out")), checkpoint=str(tmp_path / "ck"), available_now=True)
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(str(tmp_path / "out/epoch=*"))


MSG = "stream_id string, seq long, type string, text string, start_time double, end_time double, is_final boolean, speech_final boolean"


@pytest.mark.parametrize("shuffled", [False, True])
def test_utterance_assembly(spark, tmp_path, shuffled):
    def r(seq, text, start, final=False, speech=False, kind="Results"):
        return ("s", seq, kind, text, start, start + 1.0, final, speech)

    rows = [
        r(0, "in", 0.0), r(1, "in the", 0.1), r(2, "in the end", 0.2, True), r(3, "in the end.", 0.2, True, True),
        r(4, "next", 5.0), r(5, "other", 9.0), r(6, "", 0.0, kind="UtteranceEnd"), r(7, "alone.", 20.0, True),
        r(8, "open", 30.0), r(9, "late final.", 40.0, True, True), r(10, "never closed", 50.0),
    ]
    path = _feed(spark, tmp_path, rows, MSG, shuffled=shuffled)
    out = _run(stateful.assemble_utterances(_events(spark, path, MSG)), tmp_path, "utt").orderBy("seq", "start_time").collect()
    assert sorted((x["seq"], x["text"]) for x in out) == [
        (3, "in the end."), (5, "next"), (6, "other"), (7, "alone."), (9, "late final."), (9, "open"), (10, "never closed")]


def test_utterances_keep_their_words(spark, tmp_path):
    schema = MSG + ", words array<struct<text:string,start_time:double>>"
    said = [("hello", 0.0), ("there", 0.5)]
    rows = [("s", 0, "Results", "hello", 0.0, 1.0, False, False, said[:1]),
            ("s", 1, "Results", "hello there", 0.0, 1.0, True, True, said)]
    path = str(tmp_path / "in")
    frame = spark.createDataFrame(rows, schema).withColumn("event_time", F.timestamp_seconds(F.lit(1_000_000)))
    frame.coalesce(1).write.json(path)
    end = spark.createDataFrame([("~", 0, *[None] * 7)], schema)
    end.withColumn("event_time", F.timestamp_seconds(F.lit(2_000_000))).write.mode("append").json(path)
    (row,) = _run(stateful.assemble_utterances(_events(spark, path, schema)), tmp_path, "words").collect()
    assert row["text"] == "hello there" and "there" in row["words"]


EVT = sources.EVENT_SCHEMA


@pytest.mark.parametrize("shuffled", [False, True])
def test_live_session(spark, tmp_path, shuffled):
    def e(seq, kind, text=None, final=True, ref=(None, None, None, None)):
        return ("s", seq, None, kind, text, final, None, *ref)

    rows = [
        e(0, "segment", "we know that love"), e(1, "segment", "yes we know that love is kind"),
        e(2, "segment", "and it endures."), e(3, "segment", "next verse"),
        e(4, "present", ref=("NKJV", "John", 3, 16)), e(5, "segment", "next verse"), e(6, "clear"),
        e(7, "segment", "next verse"), e(8, "mode", "manual"), e(9, "segment", "god says hear this now."),
        e(10, "mode", "autopilot"), e(11, "segment", "paul says one two three", False), e(12, "segment", "paul says one two three four."),
        e(13, "segment", "turn to John 3:16"), e(14, "segment", "take it down"),
        e(15, "segment", "paul writes that love is kind"),
    ]
    path = _feed(spark, tmp_path, rows, EVT, parts=4, shuffled=shuffled)
    events = _events(spark, path, EVT)
    out = _run(stateful.live_session(events), tmp_path, "live").orderBy("seq").collect()
    got = [(r["seq"], r["out_kind"], r["text"], r["a_item"], r["mode"]) for r in out]
    assert got == [
        (2, "quote", "yes we know that love is kind and it endures.", None, "semi_autopilot"),
        (3, "nav", "next verse", None, "semi_autopilot"), (5, "nav", "next verse", 16, "semi_autopilot"),
        (6, "clear", None, 16, "semi_autopilot"), (7, "nav", "next verse", 16, "semi_autopilot"),
        # an opener closes the interim text before the final one is collected
        (12, "quote", "paul says one two three", 16, "autopilot"), (12, "quote", "paul says one two three four.", 16, "autopilot"),
        (13, "explicit", "turn to John 3:16", 16, "autopilot"), (14, "clear", "take it down", 16, "autopilot"),
        (15, "quote", "paul writes that love is kind", 16, "autopilot"),  # closed by silence
    ]


def test_a_named_edition_comes_first_without_an_anchor(spark, tmp_path):
    rows = [("s", 0, None, "segment", "next verse now in the esv", True, None, None, None, None, None)]
    path = _feed(spark, tmp_path, rows, EVT, parts=1)
    (row,) = _run(stateful.live_session(_events(spark, path, EVT)), tmp_path, "swap").collect()
    assert (row["out_kind"], row["action"], row["swap"]) == ("nav", "swap_translation", "ESV")


def test_queue_sizes_do_not_depend_on_the_order_of_files(spark, tmp_path):
    schema = "stream_id string, seq long, kind string, item long"
    rows = [("s", i, ["queue_add", "queue_add", "queue_remove", "queue_add", "queue_clear"][i % 5], i // 5)
            for i in range(20)]
    path = _feed(spark, tmp_path, rows, schema, parts=5, shuffled=True)
    out = _run(stateful.queue_changes(_events(spark, path, schema)), tmp_path, "queue").collect()
    waiting, want = [], []
    for _, seq, kind, item in rows:
        waiting = waiting + [item] if kind == "queue_add" else [] if kind == "queue_clear" else [w for w in waiting if w != item]
        want.append((seq, len(waiting)))
    assert sorted((r["seq"], r["waiting"]) for r in out) == want


def test_restart_resumes_from_the_checkpoint(spark, tmp_path):
    schema = "stream_id string, seq long, text string, event_time timestamp"

    def write(rows):
        frame = spark.createDataFrame(rows, "stream_id string, seq long, text string")
        at = F.timestamp_seconds(F.lit(1_000_000) + F.col("seq") * 100)
        frame.withColumn("event_time", at).coalesce(1).write.mode("append").json(path)

    def go(name):
        stream = sources.read_events(spark, path, schema, files_per_trigger=1, lateness="250 seconds")
        return _run(stateful.trim_overlaps(stream), tmp_path, name)

    path = str(tmp_path / "in")
    write([("s", 0, "a b c"), ("s", 2, "c d e")])
    go("r1")
    write([("s", 1, "b c d"), ("s", 2, "c d e"), ("s", 3, "e")])  # 1 comes late, 2 again; of 3 nothing is left
    write([("~", 9, "")])
    out = go("r2").filter("stream_id = 's'").collect()
    assert sorted((r["seq"], r["trimmed"]) for r in out) == [(0, "a b c"), (1, "d"), (2, "c d e")]


def test_late_rows_are_counted(spark, tmp_path):
    schema = "k string, event_time timestamp"
    path = str(tmp_path / "in")
    df = spark.createDataFrame([("a", 1000), ("a", 5000)], "k string, s long").select("k", F.timestamp_seconds("s").alias("event_time"))
    df.filter("event_time > timestamp_seconds(2000)").coalesce(1).write.mode("append").json(path)
    events = sources.read_events(spark, path, schema, files_per_trigger=1)
    counts = events.groupBy("k", F.window("event_time", "10 seconds")).agg(F.count("*").alias("n"))

    def go():
        q = jobs.run(counts, "late", lambda d, i: d.count(), checkpoint=str(tmp_path / "ck"), available_now=True)
        q.awaitTermination()
        return sources.late_rows(q)

    assert go() == 0
    df.filter("event_time < timestamp_seconds(2000)").coalesce(1).write.mode("append").json(path)
    assert go() == 1


def test_detect_live_publishes_full_detections(spark, tmp_path):
    import json

    verse = "love is patient and kind and it does not envy or boast in anything"
    passages = spark.createDataFrame(
        [(1, "NKJV", "John", 3, 16, verse), (2, "NKJV", "John", 3, 17, "quite another sentence about rivers and stones")],
        "passage_id long, edition string, work string, section int, item int, text string",
    )
    rows = [("s", i, None, "segment", t, True, None, None, None, None, None) for i, t in enumerate(
        [f"The Bible says {verse}.", "turn to John 3:17"]
    )]
    path = _feed(spark, tmp_path, rows, EVT, parts=1)
    session = stateful.live_session(_events(spark, path, EVT))
    out = str(tmp_path / "feed")
    jobs.detect_live(session, passages, out, checkpoint=str(tmp_path / "ck"), available_now=True).awaitTermination()
    feed = {}
    for r in spark.read.json(f"{out}/epoch=*").collect():
        feed.setdefault(r["type"], []).append(json.loads(r["payload"]))
    (found,) = feed["detection"]
    assert (found["reference"], found["edition"], found["passage_text"]) == ("John 3:16", "NKJV", verse)
    assert found["stream_id"] == "s" and found["confidence_percent"] >= 60
    assert feed["display_update"][0]["item"] == 17 and feed["session_update"][0]["mode"] == "semi_autopilot"


def test_sentences_of_a_segment_are_routed_for_themselves(spark, tmp_path):
    rows = [("s", 0, None, "segment", "Amen to that my friends. The Bible says love is kind. Next verse.", True, *[None] * 5),
            ("s", 1, None, "segment", "so it is written", False, *[None] * 5), ("s", 2, None, "clear", None, None, *[None] * 5)]
    path = _feed(spark, tmp_path, rows, EVT, parts=1)
    session = stateful.live_session(stateful.sentence_events(_events(spark, path, EVT)))
    out = _run(session, tmp_path, "sentences").collect()
    assert [(r["seq"], r["out_kind"], r["text"]) for r in sorted(out, key=lambda r: r["seq"])] == [
        (0, "quote", "Amen to that my friends."), (0, "quote", "The Bible says love is kind."), (0, "nav", "Next verse."),
        (2, "clear", None), (2, "quote", "so it is written"),
    ]


def test_stream_rows_reach_the_fold_unrounded(spark, tmp_path):
    """Rows travel as JSON made by Spark; a frame's own JSON cuts numbers at ten decimals."""
    schema = "stream_id string, seq long, mode string, is_final boolean, confidence double"
    rows = [("s", 1, "autopilot", False, None), ("s", 2, None, True, 0.5999999999999), ("s", 3, None, True, 0.6)]
    path = _feed(spark, tmp_path, rows, schema)
    out = _run(stateful.mode_gates(_events(spark, path, schema)), tmp_path, "unrounded")
    assert [(r["seq"], r["presented"]) for r in out.filter("stream_id = 's'").orderBy("seq").collect()] == [
        (1, False), (2, False), (3, True)]


def test_rows_of_a_file_are_dealt_to_all_cores(spark):
    from quotelake.catalog import stream_queries

    events = spark.range(20).select(
        F.lit("s").alias("stream_id"), F.col("id").alias("seq"), F.timestamp_seconds(F.col("id") + 1_000_000).alias("event_time"))
    plan = stream_queries._replayed(events, "dealt")._jdf.queryExecution().logical().toString()
    assert f"Repartition {spark.sparkContext.defaultParallelism}, true" in plan
