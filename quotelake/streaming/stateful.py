"""Keyed state machines of the live path.

Rows of a stream are folded in `seq` order, whatever the files and micro-batches they come in: a row
waits in the state until the watermark has passed its `event_time`, so the state holds what may still
be overtaken, that is the rows of the lateness, and a handful of fields. Rows that repeat a `seq` count
once. Rows behind the watermark are dropped by Spark and counted (`sources.late_rows`). What is open
when a stream has been silent for `idle` is delivered then.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import config as C
from .. import lexicons as L
from ..functions import references as R
from ..functions import text as T
from ..operators import router
from ..operators.navigation import Navigator

IDLE_MS = 60_000


class Row(dict):
    """An event as its fields."""

    __getattr__ = dict.__getitem__


def _in_order(
    df: DataFrame, start: tuple, fold: Callable, finish: Callable | None, out: str, state: str,
    idle_ms: int = IDLE_MS,
) -> DataFrame:
    """Fold every stream in order of `seq`, and of `part` if there is one, behind the watermark.

    `fold(key, row, carried, emit)` returns what is carried on; `finish(key, last_seq, carried, emit)`
    delivers what is open once the stream was idle. Rows enter and leave Python as one JSON column, because
    a frame of many columns for the few rows that a stream has in a micro-batch costs more than the fold.
    """
    columns = [c.split()[0] for c in out.split(", ")]
    fields = [c for c in df.columns if c not in ("stream_id", "event_time")]
    at = F.unix_millis(F.col("event_time").cast("timestamp")).alias("event_time")
    body = F.to_json(F.struct(*fields, at), {"ignoreNullFields": "false"})
    slim = df.select("stream_id", "event_time", body.alias("body"))

    def place(row: dict) -> tuple[int, int]:
        return row["seq"], row.get("part", 0)

    def run(key, frames, group: GroupState):
        pending, newest, last, *carried = group.get if group.exists else ("[]", 0, -1, *start)
        held = {place(r): r for r in json.loads(pending)}
        if not group.hasTimedOut:
            for frame in frames:
                for r in map(json.loads, frame["body"]):
                    held.setdefault(place(r), r)
        mark = group.getCurrentWatermarkMs()
        ready = sorted(s for s, r in held.items() if r["event_time"] <= mark)
        rows: list[tuple] = []
        for at in ready:
            row = Row(held.pop(at))
            carried = fold(key, row, carried, rows.append)
            newest, last = max(newest, row["event_time"]), row["seq"]
        if finish and not held and last >= 0 and newest + idle_ms <= mark:
            carried = finish(key, last, carried, rows.append)
        group.update((json.dumps(list(held.values())), int(newest), int(last), *carried))
        if held:
            group.setTimeoutTimestamp(min(r["event_time"] for r in held.values()))
        elif finish and newest + idle_ms > mark:
            group.setTimeoutTimestamp(newest + idle_ms)
        if rows:
            yield pd.DataFrame({"rows": [json.dumps([dict(zip(columns, r)) for r in rows])]})

    found = slim.groupBy("stream_id").applyInPandasWithState(
        run, "rows string", f"pending string, newest long, last long, {state}", "append", GroupStateTimeout.EventTimeTimeout
    )
    typed = ", ".join(f"{name}: {kind}" for name, kind in (c.split() for c in out.split(", ")))
    return found.select(F.inline(F.from_json("rows", f"array<struct<{typed}>>")))


def trim_overlaps(segments: DataFrame) -> DataFrame:
    """Remove words that repeat the end of the previous (trimmed) text of the stream.

    Rows of which nothing is left are dropped.
    """
    limit = C.OVERLAP_WORDS

    def fold(key, row, carried, emit):
        (prev,) = carried
        text = row["text"] or ""
        before, after = prev.split(), text.split()
        top = min(len(before), len(after), limit)
        k = next((n for n in range(top, 0, -1) if before[-n:] == after[:n]), 0)
        kept = " ".join(after[k:]) if k else text
        if kept.strip(" "):
            emit((key[0], row["seq"], k, kept))
        return (kept or text,)

    slim = segments.select("stream_id", "seq", "event_time", "text")
    return _in_order(
        slim, ("",), fold, None, "stream_id string, seq long, dropped int, trimmed string", "prev string"
    )


def assemble_utterances(messages: DataFrame) -> DataFrame:
    """Final segments from interim and final recognition results.

    Input: `stream_id, seq, event_time, type, text, start_time, end_time, is_final, speech_final`, and
    `words` where there are any. Results that start within half a second refine the open utterance;
    another start commits it; a final result of the open utterance is delivered only with
    `speech_final`; an end message commits, and so does silence.
    """
    gap = C.UTTERANCE_GAP_SECONDS
    fields = ["stream_id", "seq", "event_time", "type", "text", "start_time", "end_time", "is_final", "speech_final"]
    words = F.to_json("words") if "words" in messages.columns else F.lit(None).cast("string")

    def fold(key, row, carried, emit):
        is_open, text, start, end, said = carried

        def commit():
            emit((key[0], row["seq"], text, start, end, said))

        if row["type"] != "Results":
            if is_open:
                commit()
            return (False, text, start, end, said)
        fresh = (row["text"], row["start_time"], row["end_time"], row["words"])
        same = is_open and abs(start - row["start_time"]) < gap
        if same:
            text, end, said = row["text"], row["end_time"], row["words"]
        if row["is_final"]:
            if same and not row["speech_final"]:
                return (True, text, start, end, said)
            if is_open and not same:
                commit()
            emit((key[0], row["seq"], *fresh))
            return (False, text, start, end, said)
        if not same:
            if is_open:
                commit()
            return (True, *fresh)
        return (True, text, start, end, said)

    def finish(key, last, carried, emit):
        is_open, text, start, end, said = carried
        if is_open:
            emit((key[0], last, text, start, end, said))
        return (False, text, start, end, said)

    return _in_order(
        messages.select(*fields, words.alias("words")), (False, "", 0.0, 0.0, None), fold, finish,
        "stream_id string, seq long, text string, start_time double, end_time double, words string",
        "is_open boolean, text string, start double, end double, words string",
    )


WINDOW_OUT = (
    "stream_id string, seq long, sent_id long, at long, candidate_text string, prev_text string, "
    "next_text string, text string, start_time double, end_time double"
)


def sentence_windows(
    segments: DataFrame, next_words: int = C.NEXT_WORDS, joined: bool = False
) -> DataFrame:
    """Every context window of a growing stream once, with the same rows as `sentences.segment_windows`.

    Input: `stream_id, seq, event_time, text, start_time, end_time` of final segments. A window waits until
    the words that follow it have come, or the stream falls silent, so the state holds no more than
    `next_words` sentences, the one before them and the next number. With `joined`, a sentence may run
    over segments: its open tail is held too, and its span goes from the first to the last segment.
    `seq` is the segment in which a sentence ends, `at` its event time in milliseconds.
    """
    split = F.transform(
        T.sentences(F.col("text")), lambda s: F.struct(s.alias("t"), F.slice(T.words(s), 1, next_words).alias("w"))
    )

    def fold(key, row, carried, emit):
        number, prev, tail, waiting = carried[0], carried[1], json.loads(carried[2]), json.loads(carried[3])
        for text, words in [(s["t"], s["w"]) for s in json.loads(row["sents"])]:
            start = row["start_time"]
            if tail:
                text, words, start = f"{tail[0]} {text}", (tail[1] + words)[:next_words], tail[2]
                tail = []
            if joined and text[-1] not in ".!?":
                tail = [text, words, start, row["seq"], row["event_time"], row["end_time"]]
                break  # only the last sentence of a segment can be open
            fields = (row["seq"], row["event_time"], start, row["end_time"])
            number, prev = close(key, number, prev, text, words, fields, waiting, emit)
        return (number, prev, json.dumps(tail), json.dumps(waiting))

    def close(key, number, prev, text, words, fields, waiting, emit):
        for window in waiting:
            window["next"] = (window["next"] + words)[:next_words]
        while waiting and len(waiting[0]["next"]) == next_words:
            deliver(key, waiting.pop(0), emit)
        waiting.append({"n": number, "prev": prev, "text": text, "fields": fields, "next": []})
        return number + 1, text

    def deliver(key, window, emit):
        seq, at, start, end = window["fields"]
        ahead = " ".join(window["next"])
        parts = [window["prev"], window["text"], ahead]
        emit((key[0], seq, window["n"], at, window["text"], window["prev"], ahead, " ".join(filter(None, parts)), start, end))

    def finish(key, last, carried, emit):
        number, prev, tail, waiting = carried[0], carried[1], json.loads(carried[2]), json.loads(carried[3])
        if tail:
            text, words, start, seq, at, end = tail
            number, prev = close(key, number, prev, text, words, (seq, at, start, end), waiting, emit)
        for window in waiting:
            deliver(key, window, emit)
        return (number, prev, "[]", "[]")

    rows = segments.select("stream_id", "seq", "event_time", "start_time", "end_time", F.to_json(split).alias("sents"))
    return _in_order(
        rows, (0, "", "[]", "[]"), fold, finish, WINDOW_OUT, "number long, prev string, tail string, waiting string"
    )


def windows_as_events(windows: DataFrame) -> DataFrame:
    """Sentence windows as events to route: every sentence, whole, once."""
    none = F.lit(None)
    return windows.select(
        "stream_id", F.col("sent_id").alias("seq"), F.timestamp_millis("at").alias("event_time"),
        F.lit("segment").alias("kind"), F.col("candidate_text").alias("text"), F.lit(True).alias("is_final"),
        none.cast("double").alias("confidence"), none.cast("string").alias("edition"), none.cast("string").alias("work"),
        none.cast("int").alias("section"), none.cast("int").alias("item"),
    )


SESSION_OUT = (
    "stream_id string, seq long, out_kind string, text string, action string, swap string, "
    "a_edition string, a_work string, a_section int, a_item int, mode string"
)
SESSION_STATE = (
    "acc string, mode string, edition string, work string, section int, item int"
)


def sentence_events(events: DataFrame) -> DataFrame:
    """Final segments as one event per sentence, told apart by `part`; other events as they are.

    A command or a quotation inside a segment is then routed for itself.
    """
    final = (F.col("kind") == "segment") & F.col("is_final")
    parts = F.when(final, T.sentences(F.col("text"))).otherwise(F.array("text"))
    others = [c for c in events.columns if c != "text"]
    return events.select(*others, F.posexplode(parts).alias("part", "text"))


def live_session(
    events: DataFrame, initial_mode: str = "semi_autopilot", navigator: Navigator | None = None
) -> DataFrame:
    """Route, accumulate and anchor in one state machine per stream.

    Kinds: `segment` (final or interim by `is_final`), `present` (carries the displayed
    reference), `clear`, and `mode` (name in `text`). Output kinds: `quote` (a complete quotation
    text to search), `explicit`, `nav` with the anchor of that moment, and `clear`. The anchor follows
    every display and a clear keeps it: detections that are shown come back as `present` events, and
    with a `navigator` the state itself moves to what references and steps lead to, so that
    commands can follow each other. A quotation that is open when the stream falls silent is delivered then.
    """
    col = F.col("text")
    df = router.classify(events, "text", F.lit(True))
    goal = []
    if navigator is not None:
        df = R.resolve_works(df, "ref_token", "ref_work")
        goal = ["ref_work", "ref_section", "ref_item", "named"]
    df = df.select(
        *goal, "stream_id", "seq", *[c for c in ("part",) if c in events.columns], "event_time", "kind", "text",
        "is_final", "edition", "work", "section", "item", "intent", "action", "swap", T.word_count(col).alias("n_words"),
        F.coalesce(col.rlike(L.SENTENCE_END_PATTERN), F.lit(False)).alias("ends"),
        F.coalesce(F.lower(col).rlike(L.QUOTE_OPENER_PATTERN), F.lit(False)).alias("opener"),
    )
    shortest, cue, nav, clear = C.MIN_WORDS, router.CUE, router.NAV, router.CLEAR

    def fold(key, row, carried, emit):
        acc, mode, *ref = carried

        def put(kind, text=None, action=None, swap=None):
            emit((key[0], row.seq, kind, text, action, swap, *ref, mode))

        def followed(kind, action):
            """The anchor after a command; one that leads nowhere keeps it."""
            if navigator is None or kind == "clear":
                return ref
            if kind == "explicit":
                to = navigator.find(row.named, row.ref_work, row.ref_section, row.ref_item)
            else:
                to = navigator.moved(-1 if ref[0] is None else navigator.find(*ref), action, row.swap)
            return list(navigator.keys[to]) if to >= 0 else ref

        if row.kind == "mode":
            mode = row.text
        elif row.kind == "present":
            ref = [row.edition, row.work, int(row.section), int(row.item)]
        elif row.kind == "clear":
            put("clear")
        elif mode == "manual":
            pass
        elif not row.is_final:
            text = row.text.strip()
            if row.n_words >= shortest:
                if acc is not None and row.opener:
                    put("quote", acc)
                acc = text
        elif row.intent != cue:
            if acc is not None:
                put("quote", acc)
            acc = None
            kind = "nav" if row.intent == nav else "clear" if row.intent == clear else "explicit"
            # without an anchor there is nothing to step from: a named edition comes first
            free_swap = row.intent == nav and ref[0] is None and row.swap is not None
            action = "swap_translation" if free_swap else row.action
            put(kind, row.text, action, row.swap)
            ref = followed(kind, action)
        elif row.n_words >= shortest:
            if acc is not None and row.opener:
                put("quote", acc)
                acc = None
            if acc is None or row.text in acc or acc in row.text:
                acc = row.text
            else:
                acc = acc + " " + row.text
            if row.ends:
                put("quote", acc)
                acc = None
        return (acc, mode, *ref)

    def finish(key, last, carried, emit):
        acc, mode, *ref = carried
        if acc is not None:
            emit((key[0], last, "quote", acc, None, None, *ref, mode))
        return (None, mode, *ref)

    return _in_order(
        df, (None, initial_mode, None, None, None, None), fold, finish, SESSION_OUT, SESSION_STATE
    )


def mode_gates(
    events: DataFrame, initial: str = "semi_autopilot", threshold: float = C.AUTOPILOT_THRESHOLD
) -> DataFrame:
    """Each event with the mode in force before it, as `live.gate_by_mode` gives for a whole log.

    Input: `stream_id, seq, event_time, mode` (null where it does not change), `is_final, confidence`. Events
    wait behind the watermark, so a mode change holds for what follows it, whatever came first.
    """
    def fold(key, row, carried, emit):
        (mode,) = carried
        sure = row["is_final"] and row["confidence"] is not None and row["confidence"] >= threshold
        emit((key[0], row["seq"], mode, mode != "manual", bool(mode == "autopilot" and sure)))
        return (row["mode"] or mode,)

    slim = events.select("stream_id", "seq", "event_time", "mode", "is_final", "confidence")
    out = "stream_id string, seq long, mode string, accepted boolean, presented boolean"
    return _in_order(slim, (initial,), fold, None, out, "mode string")


def display_changes(events: DataFrame, kind: str, value: str) -> DataFrame:
    """What every stream shows, as an aggregate for update mode: a row replaces the earlier one of its stream.

    The last present or clear event by `seq` decides, in whatever order they come.
    """
    relevant = events.filter(F.col(kind).isin("present", "clear"))
    last = relevant.groupBy("stream_id").agg(F.max(F.struct("seq", kind, value)).alias("_s"))
    shown = F.when(F.col(f"_s.{kind}") == "present", F.col(f"_s.{value}"))
    return last.select("stream_id", F.col("_s.seq").alias("as_of"), shown.alias("shown"))


def queue_changes(events: DataFrame, item: str = "item") -> DataFrame:
    """Number of waiting items after every add, remove and clear; the items stay in the state."""
    def fold(key, row, carried, emit):
        waiting = json.loads(carried[0])
        if row.kind == "queue_add":
            waiting.append(row.item)
        elif row.kind == "queue_remove":
            waiting = [w for w in waiting if w != row.item]
        elif row.kind == "queue_clear":
            waiting = []
        emit((key[0], row.seq, len(waiting)))
        return (json.dumps(waiting),)

    slim = events.select("stream_id", "seq", "event_time", "kind", F.col(item).alias("item"))
    return _in_order(slim, ("[]",), fold, None, "stream_id string, seq long, waiting long", "waiting string")
