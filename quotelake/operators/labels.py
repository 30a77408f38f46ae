"""Labelling sets: forced line breaks, greedy lines, suggested labels, cleaning and reports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from .. import lexicons as L
from ..functions import text as T
from . import ordered
from .ordered import CHUNK, Axis

# the first letter rules out most places before the phrases are tried
_FIRST = "".join(sorted({phrase[0] for phrase in L.trigger_table()}))
TRIGGER_PATTERN = rf"(?i)\b(?=[{_FIRST}])" + L.either(L.trigger_table()) + r"\b"


def _blanks(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _first_per_place():
    """Arrow function: places to break at, ascending, each with its first trigger.

    The word at which a trigger starts is the number of blanks in all gaps and triggers before it.
    """

    @F.arrow_udf("array<struct<at:int,nr:int>>")
    def places(gaps: pa.Array, held: pa.Array, back: pa.Array) -> pa.Array:
        result = []
        for gap, inside, steps in zip(*(x.to_pylist() for x in (gaps, held, back))):
            inside = np.array(inside or [], np.int64)
            word = np.cumsum(np.array(gap or [], np.int64)[:len(inside)]) + np.cumsum(inside) - inside
            at, number = np.unique(np.maximum(word - np.array(steps or [], np.int64), 0), return_index=True)
            result.append([{"at": a, "nr": n} for a, n in zip(at.tolist(), number.tolist())])
        return pa.array(result, pa.list_(pa.struct([("at", pa.int32()), ("nr", pa.int32())])))

    return places


def lookback(phrase: Column) -> Column:
    """Words to step back: a few phrases have a distance of their own."""
    table = L.trigger_table()
    expr = F.lit(L.TRIGGER_STEP)
    for back in sorted({b for b in table.values() if b != L.TRIGGER_STEP}):
        expr = F.when(phrase.isin([p for p, b in table.items() if b == back]), back).otherwise(expr)
    return expr


def break_positions(files: DataFrame, words: str = "words") -> DataFrame:
    """Add `breaks`: sorted array<struct<at, phrase>>, the first trigger per position kept.

    Triggers are found in the words joined by single blanks. The text between them comes from a split on
    the same pattern, so word positions are running counts of blanks; the work is linear in the triggers.
    """
    joined = F.array_join(words, " ")
    df = files.withColumns({
        "_found": F.transform(F.regexp_extract_all(joined, F.lit(f"({TRIGGER_PATTERN})"), 1), F.lower),
        "_gaps": F.transform(F.split(joined, TRIGGER_PATTERN), _blanks),
    })
    df = df.withColumn(
        "_first", _first_per_place()("_gaps", F.transform("_found", _blanks), F.transform("_found", lookback))
    )
    breaks = F.transform("_first", lambda b: F.struct(b["at"].alias("at"), F.get("_found", b["nr"]).alias("phrase")))
    return df.withColumn("breaks", breaks).drop("_found", "_gaps", "_first")


def _spaced(gap: int):
    """Arrow function: indexes of the places kept, each at least `gap` after the last kept one."""

    @F.arrow_udf("array<int>")
    def kept(places: pa.Array) -> pa.Array:
        result = []
        for row in places:
            at = row.values.to_numpy(zero_copy_only=False) if row.is_valid else np.zeros(0, int)
            out, k = [], 0
            while k < len(at):
                out.append(k)
                k = int(np.searchsorted(at, at[k] + gap, side="left"))
            result.append(out)
        return pa.array(result, pa.list_(pa.int32()))

    return kept


def thin_breaks(df: DataFrame, min_gap: int = C.LINE_MIN_WORDS, breaks: str = "breaks") -> DataFrame:
    """Keep a break only if it is at least `min_gap` words after the last kept one."""
    df = df.withColumn("_kept", _spaced(min_gap)(F.transform(breaks, lambda b: b["at"])))
    return df.withColumn(breaks, F.transform("_kept", lambda k: F.get(breaks, k))).drop("_kept")


def break_rows(df: DataFrame, keys: list[str], breaks: str = "breaks") -> DataFrame:
    """One row per break: `at` and `phrase`.

    With `inline` Spark would test for rows without breaks at the scan, and search all texts a second time for that.
    """
    rows = df.select(*keys, F.inline_outer(breaks))
    return rows.filter(F.col("at").isNotNull())


def line_ends(target: int, shortest: int, longest: int):
    """Arrow function giving (first word, word after the last, break at the first word or -1) of every
    greedy line of a file."""

    @F.arrow_udf("array<struct<start:int,stop:int,hit:int>>")
    def ends(closes: pa.Array, breaks: pa.Array) -> pa.Array:
        result = []
        for row, at in zip(closes, breaks):
            closing = row.values.to_numpy(zero_copy_only=False) if row.is_valid else np.zeros(0, bool)
            forced = at.values.to_numpy(zero_copy_only=False) if at.is_valid else np.zeros(0, int)
            full_stops = np.flatnonzero(closing)
            n, cursor, out = len(closing), 0, []
            while cursor < n:
                start, later = cursor, int(np.searchsorted(forced, cursor, side="right"))
                if later < len(forced) and forced[later] - cursor <= longest:
                    cursor = int(forced[later])
                else:
                    k = int(np.searchsorted(full_stops, cursor + shortest - 1))
                    near = k < len(full_stops) and full_stops[k] < cursor + longest
                    cursor = int(full_stops[k]) + 1 if near else min(cursor + target, n)
                hit = later - 1 if later and forced[later - 1] == start else -1
                out.append({"start": start, "stop": cursor, "hit": hit})
            result.append(out)
        kind = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("hit", pa.int32())])
        return pa.array(result, pa.list_(kind))

    return ends


def build_lines(
    files: DataFrame, target: int = C.LINE_TARGET_WORDS, shortest: int = C.LINE_MIN_WORDS,
    longest: int = C.LINE_MAX_WORDS,
) -> DataFrame:
    """Cut the words of each file into labelling lines.

    `files` holds `words` and thinned `breaks`; optional `starts`/`ends` arrays give word times.
    A file is one row, so a source with very many files spreads over all tasks.
    """
    closes = F.transform("words", lambda w: F.substring(w, -1, 1).isin(".", "?", "!"))
    at = F.transform("breaks", lambda b: b["at"])
    df = files.withColumn("_ends", line_ends(target, shortest, longest)(closes, at))

    def line(cut, i):
        start, stop = cut["start"], cut["stop"]
        phrase = F.when(cut["hit"] >= 0, F.get("breaks", F.greatest(cut["hit"], F.lit(0)))["phrase"])
        fields = [
            (i + 1).alias("line_no"), start.alias("first_word"), stop.alias("next_word"),
            F.array_join(F.slice("words", start + 1, stop - start), " ").alias("text"),
            F.coalesce(phrase, F.lit("")).alias("matched_trigger"),
        ]
        if "starts" in files.columns:
            fields.append(F.get("starts", start).alias("start_time"))
            fields.append(F.get("ends", stop - 1).alias("end_time"))
        return F.struct(*fields)

    keep = [c for c in files.columns if c not in ("words", "breaks", "starts", "ends", "text")]
    lines = df.select(*keep, F.inline_outer(F.transform("_ends", line)))
    return lines.filter(F.col("line_no").isNotNull())


def suggest(df: DataFrame, text: str = "text", trigger: str = "matched_trigger") -> DataFrame:
    """Add `auto_score`, `label` and `subtype`; each pattern is tested once per row."""
    df = df.withColumns(
        {"_ref": T.has_label_reference(F.col(text)), "_neg": T.is_negative(F.col(text)),
         "_old": T.has_archaic(F.col(text))}
    )
    df = df.withColumn(
        "auto_score",
        T.suggested_score(F.col(trigger), F.col("_ref"), F.col("_old"), F.col("_neg")),
    )
    keep = ~F.col("_neg") & (F.col("auto_score") >= 0.5)
    sub = F.when(F.col("_ref"), "explicit_reference").otherwise("cue_phrase")
    return df.withColumns(
        {
            "label": F.when(keep, "positive").otherwise("negative"),
            "subtype": F.when(keep, sub).otherwise("negative"),
        }
    ).drop("_ref", "_neg", "_old")


def valid_label(label: Column) -> Column:
    return T.clean_trim(F.lower(F.coalesce(label, F.lit("")))).isin("positive", "negative")


def repair_labels(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean rows, dropped rows): label and subtype made consistent."""
    label = T.clean_trim(F.lower("label"))
    sub = T.clean_trim(F.lower(F.coalesce("subtype", F.lit(""))))
    fixed = (
        F.when(F.col("label") == "negative", "negative")
        .when(sub.isin("cue_phrase", "explicit_reference"), sub)
        .when(T.has_label_reference(F.col("text")), "explicit_reference")
        .otherwise("cue_phrase")
    )
    good = rows.filter(valid_label(F.col("label"))).withColumn("label", label)
    return good.withColumn("subtype", fixed), rows.filter(~valid_label(F.col("label")))


def anonymise(name: Column, mapping: dict[str, str]) -> Column:
    """Replace names by the label of a contained substring; later entries win."""
    low = F.lower(name)
    expr = name
    for part, label in mapping.items():
        expr = F.when(F.contains(low, F.lit(part.lower())), label).otherwise(expr)
    return expr


def unmapped(names: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """Distinct names no mapping entry matches."""
    low = F.lower(F.col(column))
    hit = F.lit(False)
    for part in mapping:
        hit = hit | F.contains(low, F.lit(part.lower()))
    return names.filter(~hit).select(column).distinct()


def row_slice(df: DataFrame, keys: list[str], order: str, start: int, end: int) -> DataFrame:
    """Rows [start, end) in file order."""
    axis = Axis(tuple(keys), (order,))
    out = ordered.dense_index(df, axis, "_row").filter((F.col("_row") >= start) & (F.col("_row") < end))
    return out.drop("_row", CHUNK)


def distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts and percentages; the total is one aggregated row, not a window over all rows."""
    counts = df.groupBy(*columns).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total")).withColumn("_one", F.lit(1))
    # a single aggregated row, so this broadcast is bounded
    joined = counts.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").drop("_one")
    return joined.withColumn("share", F.col("n") / F.col("total")).drop("total")
