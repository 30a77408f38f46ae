"""Line dedup by a segment-partition edit join, in DataFrame operations only.

A line within ``edits`` edits of another keeps at least one of that line's edits + 1 segments whole, at
a place shifted by no more than the edits before and after it allow. Every line is indexed by its own
segments and probes with the few substrings that such a segment can be, for its own and the slightly
smaller lengths. Lines that meet must agree in how often letters occur, but for two counts per edit.
Candidates are confirmed by an edit automaton that runs over a band of diagonals held
in one bit set per number of edits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotelake.llm.common import bounded_broadcast, saved

EDITS, MIN_CHARS = 2, 20
BLOCKS = 16
SKETCH_LETTERS = "enatrisohldcumpgbfwv"


def _segment(length: Column, number: int, edits: int) -> tuple[Column, Column]:
    """Start (from 1) and size of a segment: the last ones take the remainder."""
    parts = edits + 1
    size = F.floor(length / parts)
    short = parts - length % parts  # so many segments have the smaller size
    before = F.lit(number)
    return before * size + F.greatest(before - short, F.lit(0)) + 1, size + F.when(before >= short, 1).otherwise(0)


def _keys(lines: DataFrame, edits: int) -> DataFrame:
    """(key, v) of every probe: v is twice the line's id, plus one where the probe is an own segment.

    All probes of one segment lie around the same place, so they are cut from one piece of the line.
    """
    reach = 2 * edits  # shifts and smaller lengths move a probe by no more
    n = F.col("n")
    pieces = {}
    for number in range(edits + 1):
        start, _ = _segment(n, number, edits)
        begin = F.greatest(start - reach, F.lit(1)).cast("int")
        pieces[f"p{number}"] = F.substring("line", begin, (F.floor(n / (edits + 1)) + 2 * reach + 2).cast("int"))
    cut = lines.select("id63", "n", *[piece.alias(name) for name, piece in pieces.items()])
    probes = []
    for less, number, shift in probe_shifts(edits):
        start, size = _segment(n - less, number, edits)
        begin = F.greatest(_segment(n, number, edits)[0] - reach, F.lit(1))
        text = F.substring(f"p{number}", (start + shift - begin + 1).cast("int"), size.cast("int"))
        own = 1 if (less, shift) == (0, 0) else 0
        probes.append(F.struct(
            F.xxhash64(F.lit(number), n - less, text).alias("key"),
            F.shiftleft("id63", 1).bitwiseOR(own).alias("v"),
        ))
    return cut.select(F.inline(F.array(*probes)))


def sketch(line: Column) -> Column:
    """How often each of twenty letters occurs, modulo eight, in three bits each."""
    size = F.octet_length(line)
    counts = [
        F.shiftleft((size - F.octet_length(F.replace(line, F.lit(c), F.lit("")))).bitwiseAND(7).cast("long"), 3 * k)
        for k, c in enumerate(SKETCH_LETTERS)
    ]
    return reduce(Column.bitwiseOR, counts)


def sketch_distance(a: Column, b: Column) -> Column:
    """A lower bound of the letters' count differences; an edit changes two counts by one at most."""
    total = F.lit(0)
    for k in range(len(SKETCH_LETTERS)):
        apart = F.abs(
            F.shiftright(a, 3 * k).bitwiseAND(7).cast("int") - F.shiftright(b, 3 * k).bitwiseAND(7).cast("int")
        )
        total = total + F.least(apart, 8 - apart)
    return total


def probe_shifts(edits: int) -> list[tuple[int, int, int]]:
    """(how much smaller the other line is, segment, shift) of every substring to look up."""
    out = []
    for less in range(edits + 1):
        for number in range(edits + 1):
            left = range(-number, number + 1)
            rest = edits - number
            out += [(less, number, s) for s in left if less - rest <= s <= less + rest]
    return out


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, k, place, line, n) of every line long enough; k tells texts of a repeated id apart."""
    line = F.trim(F.col("line"))
    return (
        docs.where("id is not null").select("id", "k", F.posexplode(F.split("text", "\n")).alias("place", "line"))
        .select("id", "k", F.col("place").cast("long").alias("place"), line.alias("line"))
        .withColumn("n", F.length("line")).where(F.col("n") >= min_chars)
    )


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether two arrays of characters are within ``edits`` edits: a bit set of diagonals per number.

    Bit d of set e says that with e edits the text so far meets place d - edits of the other string.
    """
    full = (1 << (2 * edits + 1)) - 1
    width = 2 * edits + 1
    start = 0
    for e in range(edits + 1):
        level = sum(1 << (edits + d) for d in range(e + 1))
        start |= level << (width * e)

    def step(state: Column, i: Column) -> Column:
        match = F.lit(0)
        for d in range(width):
            same = F.get(a, i) == F.when(i + d >= edits, F.get(b, i + (d - edits)))
            match = match.bitwiseOR(F.when(same, F.lit(1 << d)).otherwise(0))
        sets = [F.shiftright(state, width * e).bitwiseAND(full) for e in range(edits + 1)]
        fresh, out = None, None
        for e in range(edits + 1):
            now = sets[e].bitwiseAND(match)
            if e:
                now = now.bitwiseOR(sets[e - 1]).bitwiseOR(F.shiftright(sets[e - 1], 1))
                now = now.bitwiseOR(F.shiftleft(fresh, 1)).bitwiseAND(full)
            fresh = now
            part = F.shiftleft(now, width * e)
            out = part if out is None else out.bitwiseOR(part)
        return out

    end = F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), F.lit(start), step)
    last = F.size(b) - F.size(a) + edits
    return (
        (F.abs(F.size(a) - F.size(b)) <= edits)
        & (F.getbit(F.shiftright(end, width * edits), last) == 1)
    )


def blocks_agree(a: Column, b: Column, edits: int) -> Column:
    """Whether all but ``edits`` of sixteen blocks of a stand in b at nearly the same place.

    True for all strings within ``edits`` edits, and cheap; short strings are not looked at.
    """
    size = F.floor(F.length(a) / BLOCKS).cast("int")
    total = F.lit(0)
    for k in range(BLOCKS):
        start = size * k + 1
        window = F.substring(b, F.greatest(start - edits, F.lit(1)), size + 2 * edits)
        total = total + F.when(F.contains(window, F.substring(a, start, size)), 1).otherwise(0)
    return (size < 2 * edits) | (total >= BLOCKS - edits)


def line_links(lines: DataFrame, edits: int) -> DataFrame:
    """(a, a2, b, b2): digests of every two different lines within ``edits`` edits.

    ``lines`` has each different line once: h, h2, n, line. Only the rows of keys that several lines
    have go on, and only their lines' texts are looked at again.
    """
    id63 = F.shiftrightunsigned("h", 1)
    rows = _keys(lines.withColumn("id63", id63), edits)
    line_of = F.shiftrightunsigned("v", 1)
    key = Window.partitionBy("key")
    shared = saved(
        rows.withColumns({"low": F.min(line_of).over(key), "high": F.max(line_of).over(key)})
        .where("low < high").select("key", "v"), "line-keys",
    )
    ids = saved(shared.select(line_of.alias("id63")).distinct(), "line-ids")
    texts = saved(
        lines.withColumn("id63", id63).join(bounded_broadcast(ids, ids.count()), "id63", "left_semi")
        .select("id63", "h", "h2", "line", sketch(F.col("line")).alias("s")), "line-texts",
    )
    marked = shared.withColumn("id63", line_of).join(texts.select("id63", "s"), "id63")
    own = marked.where(F.col("v").bitwiseAND(1) == 1).select("key", F.col("id63").alias("b"), F.col("s").alias("t"))
    pairs = saved(
        marked.select("key", F.col("id63").alias("a"), "s").join(own, "key")
        .where((F.col("a") != F.col("b")) & (sketch_distance(F.col("s"), F.col("t")) <= 2 * edits))
        .select("a", "b").distinct(), "line-pairs",
    )
    left = texts.select(F.col("id63").alias("a"), F.col("h").alias("ah"), F.col("h2").alias("a2"), F.col("line").alias("x"))
    right = texts.select(F.col("id63").alias("b"), F.col("h").alias("bh"), F.col("h2").alias("b2"), F.col("line").alias("y"))
    # comparing costs much more than its few bytes suggest: keep the number of partitions
    spread = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = pairs.join(left, "a").join(right, "b").where(blocks_agree(F.col("x"), F.col("y"), edits)).repartition(spread)
    # characters as columns of their own, which a filter is not moved below: they are split once
    split = F.struct(F.split("x", "").alias("p"), F.split("y", "").alias("q"))
    chars = both.select("ah", "a2", "bh", "b2", F.inline(F.array(split)))
    return chars.where(within_edits(F.col("p"), F.col("q"), edits)).select(
        F.col("ah").alias("a"), "a2", F.col("bh").alias("b"), "b2"
    )


def duplicate_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS,
    min_chars: int = MIN_CHARS, copy_share: float | None = None,
) -> DataFrame:
    """(id, k, dropped): the places (from 0) of the lines to cut from each document that has any.

    A line, trimmed of blanks, is a duplicate if the same line occurs earlier (by id, then place), or if
    its first occurrence comes after that of a line within ``edits`` edits. Lines of fewer than
    ``min_chars`` characters always stay. With ``copy_share``, lines that came first in another document
    are cut only where they make up at most that share of the document's characters: what repeats more
    is a copy of a document, and is left whole for document dedup.

    k is a digest of the text, so a repeated id with different texts is kept apart; equal rows are cut
    alike. Null or empty texts have no lines; documents with a null id take no part.
    """
    docs = _keyed(docs, id_col, text_col)
    lines = _lines(docs, min_chars).withColumns(
        {"h": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")}
    )
    at = F.struct("id", "k", "place")
    seen = saved(lines.drop("line"), "line-places")
    firsts = saved(
        seen.groupBy("h", "h2").agg(F.min(at).alias("first"), F.count("*").alias("uses")), "line-firsts"
    )
    again = firsts.where("uses > 1").select("h", "h2", "first")
    once = (
        lines.join(bounded_broadcast(again, again.count(), 400_000), ["h", "h2"], "left")
        .where(F.col("first").isNull() | (F.col("first") == at)).select("h", "h2", "n", "line")
    )
    links = saved(line_links(once, edits), "line-links")
    both = links.unionByName(links.selectExpr("b as a", "b2 as a2", "a as b", "a2 as b2")).distinct()
    other = firsts.selectExpr("h as b", "h2 as b2", "first as other")
    linked = both.join(other, ["b", "b2"]).groupBy("a", "a2").agg(F.min("other").alias("other"))
    verdicts = saved(
        firsts.join(linked, (F.col("h") == F.col("a")) & (F.col("h2") == F.col("a2")), "left")
        .where("uses > 1 or other < first")
        .select("h", "h2", "first", F.when(F.expr("other < first"), F.col("other")).alias("other")), "line-verdicts",
    )
    hits = (
        seen.join(bounded_broadcast(verdicts, verdicts.count(), 400_000), ["h", "h2"])
        .where((F.col("first") != at) | F.col("other").isNotNull())
        .withColumn("own", F.coalesce("other", "first")["id"] == F.col("id"))
        .groupBy("id", "k").agg(
            # equal rows of an id have the same places: each counts once
            F.sort_array(F.collect_set(F.struct("place", "own", "n"))).alias("hits")
        )
    )
    foreign = F.aggregate("hits", F.lit(0), lambda t, s: t + F.when(s["own"], 0).otherwise(s["n"]))
    return hits.select("id", "k", foreign.alias("foreign_chars"), "hits")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("k")
    )


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS,
    min_chars: int = MIN_CHARS, copy_share: float | None = None,
) -> DataFrame:
    """The same rows and columns with duplicate lines cut from the text, and ``dropped_lines``.

    dropped_lines holds the places (from 0) of the lines cut; it is empty where none is. Null texts stay
    null; a text that loses all its lines becomes empty. A column of that name is replaced; all others may
    have any name. See ``duplicate_lines`` for what is cut.
    """
    found = duplicate_lines(docs, id_col, text_col, edits, min_chars, copy_share)
    found = saved(found, "line-hits").select(F.struct("id", "k", "foreign_chars", "hits").alias("hit"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.col(f"row.`{text_col}`")
    joined = rows.join(
        bounded_broadcast(found, found.count(), 400_000),
        (F.col(f"row.`{id_col}`") == F.col("hit.id")) & (F.xxhash64(text) == F.col("hit.k")), "left",
    )
    own_only = (
        F.lit(False) if copy_share is None
        else F.col("hit.foreign_chars") > copy_share * F.length(text)
    )
    cut = F.coalesce(
        F.transform(F.filter("hit.hits", lambda s: s["own"] | ~own_only), lambda s: s["place"].cast("int")),
        F.array().cast("array<int>"),
    )
    kept = F.array_join(
        F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(F.col("cut"), i)), "\n"
    )
    fresh = F.when(F.size("cut") > 0, kept).otherwise(text)
    return joined.withColumn("cut", cut).select(
        *[(fresh if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns if c != "dropped_lines"],
        F.col("cut").alias("dropped_lines"),
    )
