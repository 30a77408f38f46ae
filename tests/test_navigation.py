"""Chains of commands equal a plain walk over the passages, in one pass and in a stream."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quotelake.operators import navigation
from quotelake.operators.navigation import Navigator
from quotelake.streaming import jobs, sources, stateful

KEYS = [
    (e, w, s, i) for e in ("AMP", "ESV", "NKJV") for w, sizes in (("John", (3, 1, 4)), ("Jude", (2,)), ("Ruth", (2, 2)))
    for s, n in enumerate(sizes, 1) for i in range(1, n + 1) if not (e == "ESV" and (w, s) == ("John", 2))
] + [("AMP", "Mark", 5, 7), ("NKJV", "Mark", 9, 2)]  # sections with gaps between them


def walk(commands, default="NKJV"):
    """One stream, command by command, with lists and dictionaries only."""
    refs = sorted({k[1:] for k in KEYS})
    editions = {r: sorted(e for e, *k in KEYS if tuple(k) == r) for r in refs}
    at, out = None, []
    for action, edition, *ref in commands:
        to, reason = None, None
        if action == "show":
            ref = tuple(ref)
            if ref in editions:
                to = (next(e for e in (edition, default, editions[ref][0]) if e in editions[ref]), *ref)
            reason = "reference out of range"
        elif action and at is None:
            reason = "no anchor to navigate from"
        elif action == "swap_translation":
            to = (edition, *at[1:]) if edition in editions[at[1:]] else None
            reason = "edition not available"
        elif action:
            here, reason = refs.index(at[1:]), "out of range"
            same = [r for r in refs if r[0] == at[1]]
            sections = sorted({r[1] for r in same})
            k = sections.index(at[2])
            goal = {
                "next_verse": refs[here + 1:here + 2], "prev_verse": refs[here - 1:here] if here else [],
                "next_chapter": [r for r in same if k + 1 < len(sections) and r[1] == sections[k + 1]][:1],
                "prev_chapter": [r for r in same if k and r[1] == sections[k - 1]][-1:],
            }[action]
            if goal and goal[0][0] == at[1]:
                named = editions[goal[0]]
                to = (at[0] if at[0] in named else named[0], *goal[0])
        at = to or at
        out.append((*(at or (None,) * 4), None if to or not action else reason))
    return out


def commands(rng, n, shows):
    actions = [None, "swap_translation", *navigation.STEPS, *navigation.STEPS] + ["show"] * shows
    return [
        (rng.choice(actions), rng.choice(["AMP", "ESV", "NKJV", "KJV"]), rng.choice(["John", "Jude", "Ruth", "Mark", "Acts"]),
         rng.randrange(1, 4), rng.randrange(1, 5)) for _ in range(n)
    ]


@pytest.mark.parametrize("width", [4, 65536])
def test_chains_equal_a_plain_walk(spark, width):
    rng = random.Random(width)
    streams = {f"s{k}": commands(rng, rng.randrange(1, 60), k % 3) for k in range(12)}
    streams["late"] = [(None, None, None, None, None)] * 9 + [("next_verse",) + (None,) * 4, ("show", None, "John", 1, 3)] + [("next_verse", None, None, None, None)] * 30
    rows = [(s, k, *c) for s, cs in streams.items() for k, c in enumerate(cs)]
    events = spark.createDataFrame(rows, "stream_id string, seq long, action string, edition string, work string, section int, item int")
    passages = spark.createDataFrame([(*k, "t") for k in KEYS], "edition string, work string, section int, item int, text string")
    got = navigation.nav_chain(events.repartition(4), passages, width=width).orderBy("stream_id", "seq").collect()
    found = {}
    for r in got:
        found.setdefault(r["stream_id"], []).append((r["to_edition"], r["to_work"], r["to_section"], r["to_item"], r["reason"]))
    assert found == {s: walk(cs) for s, cs in streams.items()}


def test_an_empty_corpus_leads_nowhere():
    nav = Navigator([])
    assert nav.find("AMP", "John", 1, 1) == navigation.NOWHERE and nav.moved(-1, "next_verse", None) == navigation.NOWHERE
    rows = {"action": ["next_verse", None], "edition": [None] * 2, "work": [None] * 2, "section": [None] * 2, "item": [None] * 2}
    assert nav.fold(rows, navigation.NOWHERE) == [-1, -1] and nav.outcomes(rows) == {}


def test_a_corpus_beyond_the_bound_is_refused(spark, monkeypatch):
    monkeypatch.setattr(navigation, "MOST_PASSAGES", 3)
    passages = spark.createDataFrame(KEYS, "edition string, work string, section int, item int")
    with pytest.raises(ValueError, match="at most 3"):
        navigation.navigator(passages)


SEGMENT = "stream_id string, seq long, event_time timestamp, text string, start_time double, end_time double"


def _segments(spark, path, texts, rng):
    """Segments in files of their own, in any order, then one of another stream far ahead."""
    rows = [(s, k, t, k * 10.0, k * 10.0 + 9) for s, ts in texts.items() for k, t in enumerate(ts)]
    rng.shuffle(rows)
    cuts = [rows[i::4] for i in range(4)] + [[("~", 0, "the end.", 0.0, 1.0)]]
    for k, part in enumerate(cuts):
        frame = spark.createDataFrame(part, "stream_id string, seq long, text string, start_time double, end_time double")
        at = F.timestamp_seconds(F.lit(1_000_000 if k < 4 else 3_000_000) + F.col("seq"))
        frame.withColumn("event_time", at).coalesce(1).write.mode("append").json(path)
    return sources.read_events(spark, path, SEGMENT, files_per_trigger=1, lateness="1 hour")


def test_commands_over_segments_are_routed_once_and_follow_each_other(spark, tmp_path):
    texts = {
        "a": ["We begin. Please turn to", "John 3:16. Then the next", "verse. Next verse.", "", "And now the next chapter"],
        "b": ["Next verse. Turn to Jude 1:1.", "Next verse. Next verse. Previous verse."],
    }
    passages = spark.createDataFrame(
        [(n, "NKJV", w, s, i, f"{w} {s}:{i}") for n, (w, s, i) in enumerate(
            [("John", 3, 16), ("John", 3, 17), ("John", 3, 18), ("John", 4, 1), ("Jude", 1, 1), ("Jude", 1, 2)])],
        "passage_id long, edition string, work string, section int, item int, text string",
    )
    wins = str(tmp_path / "windows")
    feed = _segments(spark, str(tmp_path / "in"), texts, random.Random(4))
    jobs.window_feed(feed, wins, name="nav_w", checkpoint=str(tmp_path / "c1"), available_now=True).awaitTermination()
    said = spark.read.schema(stateful.WINDOW_OUT).parquet(f"{wins}/epoch=*").where("stream_id = 'a'").orderBy("sent_id")
    assert [(r["sent_id"], r["candidate_text"]) for r in said.collect()] == list(enumerate([
        "We begin.", "Please turn to John 3:16.", "Then the next verse.", "Next verse.", "And now the next chapter",
    ]))
    ahead = spark.createDataFrame([("~", 9, 9, 4_000_000_000, "x", "", "", "x", 0.0, 0.0)], stateful.WINDOW_OUT)
    ahead.write.parquet(f"{wins}/epoch=99999")
    nav = navigation.navigator(passages)
    session = stateful.live_session(jobs.read_windows(spark, wins), navigator=nav)
    out = str(tmp_path / "out")
    jobs.detect_live(session, passages, out, name="nav_s", checkpoint=str(tmp_path / "c2"), available_now=True).awaitTermination()
    shown = [json.loads(r["payload"]) for r in spark.read.json(f"{out}/epoch=*").where("type = 'display_update'").collect()]
    by_stream = {}
    for p in sorted((p for p in shown if "work" in p), key=lambda p: p["seq"]):
        by_stream.setdefault(p["stream_id"], []).append(f"{p['work']} {p['section']}:{p['item']}")
    assert by_stream == {"a": ["John 3:16", "John 3:17", "John 3:18", "John 4:1"], "b": ["Jude 1:1", "Jude 1:2", "Jude 1:1"]}
