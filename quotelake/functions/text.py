"""String, token-set and formatting expressions. All are built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from .. import lexicons as L


def words(text: Column) -> Column:
    """Whitespace tokens without empty strings."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(F.coalesce(text, F.lit(""))))


def clean_trim(text: Column) -> Column:
    """Trim any whitespace, not only blanks."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def norm_text(text: Column) -> Column:
    """Lower case, collapsed whitespace, trimmed: the key of the duplicate checks."""
    return F.regexp_replace(clean_trim(F.lower(text)), r"\s+", " ")


def _tokens(text: Column, stop: list[str]) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z']+)"), 1)
    return F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(stop))


def keywords(text: Column) -> Column:
    """Content words of a text, with repeats."""
    return _tokens(text, L.KEYWORD_STOP)


def keyword_set(text: Column) -> Column:
    return F.array_distinct(keywords(text))


def content_set(text: Column) -> Column:
    """Token set used to verify quotations (its own stop list)."""
    return F.array_distinct(_tokens(text, L.OVERLAP_STOP))


def content_overlap(a: Column, b: Column) -> Column:
    """Number of shared content words; arguments are token sets."""
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """|a and b| / |a or b| of two distinct arrays, 0 when both are empty."""
    inter = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - inter
    return F.when(union == 0, F.lit(0.0)).otherwise(inter / F.greatest(union, F.lit(1)))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """|a and b| / min(|a|, |b|), 0 when either is empty."""
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.greatest(smaller, F.lit(1))
    )


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def without_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"\s", "")


def lexical_score(
    shared: Column, n_query: Column, n_passage: Column, low: Column, squeezed: Column,
    work: Column, section: Column, item: Column,
) -> Column:
    """Half Jaccard, half overlap, plus 0.10 for a spoken work name and 0.10 for `section:item`.

    `shared` is the number of common keywords of two sets of the given sizes; `low` is the
    lower-cased query and `squeezed` the same without whitespace.
    """
    union, smaller = n_query + n_passage - shared, F.least(n_query, n_passage)
    jac = F.when(union == 0, F.lit(0.0)).otherwise(shared / F.greatest(union, F.lit(1)))
    ovl = F.when(smaller == 0, F.lit(0.0)).otherwise(shared / F.greatest(smaller, F.lit(1)))
    named = F.when((work != "") & F.contains(low, F.lower(work)), 0.10).otherwise(0.0)
    located = F.when(F.contains(squeezed, F.concat_ws(":", section, item)), 0.10).otherwise(0.0)
    return clamp01(0.5 * jac + 0.5 * ovl + named + located)


def reference(work: Column, section: Column, item: Column) -> Column:
    """`"{work} {section}:{item}"`."""
    return F.concat(work, F.lit(" "), section.cast("string"), F.lit(":"), item.cast("string"))


def edition_code(raw: Column) -> Column:
    """Upper-cased, mapped edition code; blank becomes UNK."""
    up = F.upper(F.trim(F.coalesce(raw, F.lit(""))))
    pairs = ", ".join(f"'{k}', '{v}'" for k, v in L.EDITION_CODES.items())
    known = F.try_element_at(F.expr(f"map({pairs})"), up)
    return F.coalesce(known, F.nullif(up, F.lit("")), F.lit("UNK"))


def band(confidence: Column) -> Column:
    return (
        F.when(confidence >= C.AUTOPILOT_THRESHOLD, C.BAND_AUTOPILOT)
        .when(confidence >= C.REVIEW_THRESHOLD, C.BAND_REVIEW)
        .otherwise(C.BAND_IGNORED)
    )


def band_order(band_col: Column) -> Column:
    return (
        F.when(band_col == C.BAND_AUTOPILOT, 0).when(band_col == C.BAND_REVIEW, 1)
        .when(band_col == C.BAND_IGNORED, 2).otherwise(3)
    )


def sentences(text: Column) -> Column:
    """Sentences of a text: split on whitespace after . ! ? and trimmed, blanks dropped."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), L.SENTENCE_SPLIT_PATTERN), clean_trim)
    return F.filter(parts, lambda s: s != "")


def query_variants(text: Column) -> Column:
    """Distinct retrieval texts: the whole, its last words, and its clauses, in that order."""
    toks = words(text)
    tail = F.array_join(F.slice(toks, -C.TAIL_WORDS, C.TAIL_WORDS), " ")
    tail_part = F.when(
        (F.size(toks) > C.TAIL_WORDS) & (tail != text), F.array(tail)
    ).otherwise(F.array().cast("array<string>"))
    clauses = F.transform(
        F.split(text, L.SENTENCE_SPLIT_PATTERN),
        lambda s: F.regexp_replace(clean_trim(s), r"[.,; ]+$", ""),
    )
    clauses = F.filter(clauses, lambda s: (word_count(s) >= C.MIN_WORDS) & (s != text))
    return F.array_distinct(F.concat(F.array(text), tail_part, clauses))


def safe_identifier(name: Column) -> Column:
    """Letters, digits and -_. kept; everything else becomes an underscore."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}\-_.]", "_")


def clock(seconds: Column) -> Column:
    """h:mm:ss of a number of seconds."""
    whole = F.floor(seconds).cast("long")
    return F.concat_ws(
        ":",
        F.floor(whole / 3600).cast("string"),
        F.lpad(F.floor((whole % 3600) / 60).cast("string"), 2, "0"),
        F.lpad((whole % 60).cast("string"), 2, "0"),
    )


def json_array(raw: Column, schema: str) -> Column:
    """Parse the outermost JSON array of a text that may be fenced."""
    unfenced = F.regexp_replace(raw, r"(?m)^```(?:json)?|```$", "")
    return F.from_json(F.regexp_extract(unfenced, r"(?s)\[.*\]", 0), schema)


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1.0 / (1.0 + F.exp(-x))).otherwise(F.exp(x) / (1.0 + F.exp(x)))


def shared_overlap(prev_words: Column, new_words: Column, limit: int = C.OVERLAP_WORDS) -> Column:
    """Longest k <= limit with the last k previous words equal to the first k new words."""
    top = F.least(F.size(prev_words), F.size(new_words), F.lit(limit))
    ks = F.filter(
        F.sequence(F.lit(0), F.lit(limit)),
        lambda k: (k >= 1) & (k <= top)
        & (F.slice(prev_words, F.size(prev_words) - k + 1, k) == F.slice(new_words, F.lit(1), k)),
    )
    return F.coalesce(F.array_max(ks), F.lit(0))


def has_label_reference(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(L.LABEL_REF_PATTERN)


def is_negative(text: Column) -> Column:
    return F.lower(text).rlike(L.either(L.NEGATIVE_MARKERS))


def has_archaic(text: Column) -> Column:
    return F.arrays_overlap(words(F.lower(text)), F.array(*[F.lit(w) for w in L.ARCHAIC_WORDS]))


def suggested_score(trigger: Column, cites: Column, archaic: Column, negative: Column) -> Column:
    """0.1, plus 0.5 for a trigger, 0.5 for a citation, 0.3 for old words, minus 0.4 for news."""
    def part(flag: Column, weight: float) -> Column:
        return F.when(flag, weight).otherwise(0.0)

    triggered = F.coalesce(trigger, F.lit("")) != ""
    return clamp01(
        F.lit(0.1) + part(triggered, 0.5) + part(cites, 0.5) + part(archaic, 0.3) - part(negative, 0.4)
    )
