"""Chains of displays and navigation commands: every step starts where the last one led.

The passages are the states of an automaton: a step is a table from passage to passage, a display of a
reference leads to one passage from anywhere. Tables compose, so a chunk of a stream is summed up by the
passage it ends in from every passage it may begin with, or by a single one once a display has been
seen, and the chunks of a stream are folded in parallel (`ordered.state_scan`).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .. import config as C
from . import ordered
from .ordered import Axis

SHOW, SWAP = "show", "swap_translation"
STEPS = ("next_verse", "prev_verse", "next_chapter", "prev_chapter")
NOWHERE, ANYWHERE = -1, -(2**31)
MOST_PASSAGES = 4_000_000


def _failed(state: int) -> int:
    """A state kept because the step of this row led nowhere."""
    return state if state == NOWHERE else -(state + 2)


def _plain(state: int) -> int:
    return state if state >= NOWHERE else -state - 2


class Navigator:
    """The passages as states, numbered by work, section, item and edition.

    Items of a work follow each other without gaps, whatever their numbers: the step behind the last
    item of a section leads to the first of the next, and a section step backward to the last item of the
    section before. A step keeps the edition, or takes the first by name where it lacks the passage.
    """

    def __init__(self, keys: list[tuple[str, str, int, int]], default: str = C.DEFAULT_EDITION) -> None:
        self.default = default
        self.keys = sorted(set(keys), key=lambda k: (k[1], k[2], k[3], k[0]))
        self.editions = sorted({k[0] for k in self.keys})
        refs = list(dict.fromkeys(k[1:] for k in self.keys))
        self.ref_at = {ref: r for r, ref in enumerate(refs)}
        code = {e: c for c, e in enumerate(self.editions)}
        self.ref = np.array([self.ref_at[k[1:]] for k in self.keys], np.int64)
        self.edition = np.array([code[k[0]] for k in self.keys], np.int64)
        self.state = np.full((len(refs), len(self.editions)), NOWHERE, np.int64)
        self.state[self.ref, self.edition] = np.arange(len(self.keys))
        self.first = np.unique(self.ref, return_index=True)[1] if refs else np.zeros(0, np.int64)
        self.tables = {step: self._table(goal) for step, goal in zip(STEPS, self._goals(refs))}
        self.tables |= {(SWAP, e): self.state[self.ref, c] for e, c in code.items()}

    @staticmethod
    def _goals(refs: list[tuple[str, int, int]]) -> list[np.ndarray]:
        """The reference that each step leads to from every reference, or nowhere."""
        n = len(refs)
        here = np.arange(n)
        works, sections = ([x[0] for x in refs], [x[:2] for x in refs])
        new_work = np.array([k == 0 or works[k] != works[k - 1] for k in range(n)], bool)
        new_section = np.array([k == 0 or sections[k] != sections[k - 1] for k in range(n)], bool)
        starts = np.flatnonzero(new_section)
        section = np.cumsum(new_section) - 1
        first_of_work = starts[new_work[starts]] if n else starts
        opening = np.isin(starts, first_of_work)
        after = np.append(starts[1:], n)
        last_in_work = np.append(opening[1:], True)
        follows = np.append(~new_work[1:], False) if n else np.zeros(0, bool)
        return [
            np.where(follows, here + 1, NOWHERE), np.where(new_work, NOWHERE, here - 1),
            np.where(last_in_work[section], NOWHERE, after[section]),
            np.where(opening[section], NOWHERE, starts[section] - 1),
        ]

    def _table(self, goal: np.ndarray) -> np.ndarray:
        to = goal[self.ref]
        same = np.where(to >= 0, self.state[np.maximum(to, 0), self.edition], NOWHERE)
        return np.where(to < 0, NOWHERE, np.where(same >= 0, same, self.first[np.maximum(to, 0)]))

    def find(self, edition: str | None, work: str | None, section: int | None, item: int | None) -> int:
        """The passage in the edition asked for, else the default one, else the first by name."""
        ref = None if None in (work, section, item) else self.ref_at.get((work, int(section), int(item)))
        if ref is None:
            return NOWHERE
        for name in (edition, self.default):
            if name in self.editions and self.state[ref, self.editions.index(name)] >= 0:
                return int(self.state[ref, self.editions.index(name)])
        return int(self.first[ref])

    def moved(self, state: int, action: str | None, edition: str | None) -> int:
        """Where one command leads from a state, or nowhere."""
        table = self.tables.get((SWAP, edition) if action == SWAP else action)
        return NOWHERE if table is None or state < 0 else int(table[state])

    def fold(self, rows: dict[str, list], state: int) -> list[int]:
        """The state after every row; a command that leads nowhere leaves it, marked as failed."""
        out, state = [], _plain(state)
        for row in zip(*(rows[c] for c in ("action", "edition", "work", "section", "item"))):
            action, edition = row[:2]
            if action is None:
                out.append(state)
                continue
            to = self.find(edition, *row[2:]) if action == SHOW else self.moved(state, action, edition)
            state = to if to >= 0 else state
            out.append(state if to >= 0 else _failed(state))
        return out

    def outcomes(self, rows: dict[str, list]) -> dict[int, int]:
        """Where a chunk ends: one state if a display leads anywhere, else a table of what it changes."""
        shown = [
            self.find(*row[1:]) if row[0] == SHOW else NOWHERE
            for row in zip(*(rows[c] for c in ("action", "edition", "work", "section", "item")))
        ]
        last = max((k for k, s in enumerate(shown) if s >= 0), default=None)
        if last is not None:
            tail = {c: v[last + 1:] for c, v in rows.items()}
            return {ANYWHERE: _plain(([shown[last], *self.fold(tail, shown[last])])[-1])}
        now = np.arange(len(self.keys))
        for action, edition in zip(rows["action"], rows["edition"]):
            table = self.tables.get((SWAP, edition) if action == SWAP else action)
            if table is not None:
                to = table[now]
                now = np.where(to >= 0, to, now)
        moved = np.flatnonzero(now != np.arange(len(now)))
        return dict(zip(moved.tolist(), now[moved].tolist()))


def navigator(passages: DataFrame, default: str = C.DEFAULT_EDITION) -> Navigator:
    """The automaton of a corpus; its keys are held by every task, so their number is checked first."""
    keys = passages.select("edition", "work", "section", "item").na.drop().distinct()
    held = keys.limit(MOST_PASSAGES + 1).collect()
    if len(held) > MOST_PASSAGES:
        raise ValueError(f"navigation holds at most {MOST_PASSAGES} passages")
    return Navigator([tuple(k) for k in held], default)


def nav_chain(
    events: DataFrame, passages: DataFrame, stream: str = "stream_id", seq: str = "seq",
    default: str = C.DEFAULT_EDITION, width: int = 65536,
) -> DataFrame:
    """Resolve every command of a stream from where the one before it led.

    `action` is `show` (a reference, in `edition` if there is one), a step, `swap_translation` (to
    `edition`) or null. Adds `to_edition, to_work, to_section, to_item`, the passage shown after the
    row (null before the first display), and `reason` where the command led nowhere and changed nothing.
    """
    columns = ["action", "edition", "work", "section", "item"]
    nav = navigator(passages, default)
    found = ordered.state_scan(
        events, Axis((stream,), (seq,), width), nav.outcomes, nav.fold, "_state", columns, NOWHERE,
        IntegerType(), anywhere=ANYWHERE,
    )
    shown = events.sparkSession.createDataFrame(
        [(s, *key) for s, key in enumerate(nav.keys)],
        "_at int, to_edition string, to_work string, to_section int, to_item int",
    )
    state, action = F.col("_state"), F.col("action")
    at = F.when(state >= 0, state).when(state < NOWHERE, -state - 2)
    reason = F.when(action.isNull() | (state >= 0), None).when(
        action == SHOW, "reference out of range"
    ).when(state == NOWHERE, "no anchor to navigate from").when(
        action == SWAP, "edition not available"
    ).otherwise("out of range")
    return (
        found.withColumns({"_at": at.cast("int"), "reason": reason}).join(shown, "_at", "left")
        .drop("_at", "_state", ordered.CHUNK)
    )
