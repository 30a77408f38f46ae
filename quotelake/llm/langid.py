"""Language identification by word-first backoff.

A known word is scored by its log frequency in each language. An unseen word falls back to its known
4-grams, else 3-grams, then 2-grams, then single letters: the mean log frequency of the first length at
which any is known. The model is fitted on a bounded sample of labelled documents (about
``sample_rows`` per language, whole texts) and keeps the most frequent words and grams per language. Every
language is learned; beyond ``full_languages`` they share what so many languages have in all.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotelake.llm.common import byte_view, ragged, steps, tidied
from quotelake.llm.words import SPACE

UNKNOWN = "und"
ORDERS = (4, 3, 2, 1)
CACHED_TOKENS, CACHED_NUMBERS = 200_000, 200_000 * 34


@dataclass(frozen=True)
class Bounds:
    """What bounds the model: rows of the sample, kept words and grams, per language.

    With more than ``full_languages`` languages, each has its share of the same totals.
    """

    sample_rows: int = 2000
    full_languages: int = 32
    words: int = 20_000
    grams: int = 10_000

    def share(self, number: int, languages: int) -> int:
        return max(1, number * self.full_languages // max(languages, self.full_languages))


@dataclass
class SparseLogs:
    """Log frequencies of entries: ``base`` per language, to which an entry adds in the languages that have it."""

    base: np.ndarray
    starts: np.ndarray
    langs: np.ndarray
    more: np.ndarray

    def means(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The mean of each run of ``sizes`` rows, per language."""
        lengths = self.starts[rows + 1] - self.starts[rows]
        at = ragged(self.starts[rows], lengths)
        owner = np.repeat(np.repeat(np.arange(len(sizes)), sizes), lengths)
        width = len(self.base)
        total = np.bincount(owner * width + self.langs[at], weights=self.more[at], minlength=len(sizes) * width)
        return self.base + total.reshape(len(sizes), width) / sizes[:, None]


@dataclass
class LanguageModel:
    """Log frequencies per language: words, then grams by ORDERS, each as entry to row and the rows' logs."""

    languages: list[str]
    prior: np.ndarray
    entries: list[dict[str, int]]
    logs: list[SparseLogs]


def remainder(id_col: Column, parts: int = 4) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % parts


def _sample(docs: DataFrame, bounds: Bounds) -> tuple[DataFrame, list[tuple[str, int]]]:
    """About ``sample_rows`` labelled rows per language, or its share, chosen by a digest of the id."""
    counts = [
        (r["lang"], r["n"]) for r in
        docs.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()
    ]
    if not counts:
        return docs.limit(0), counts
    scale, wanted = 1 << 30, bounds.share(bounds.sample_rows, len(counts))
    rates = docs.sparkSession.createDataFrame(
        [(lang, min(scale, scale * wanted // n)) for lang, n in counts], "lang string, rate long"
    )
    known = docs.join(F.broadcast(rates), "lang")
    return known.where(F.pmod(F.xxhash64("id"), F.lit(scale)) < F.col("rate")).drop("rate"), counts


def fit(
    docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
    bounds: Bounds = Bounds(),
) -> LanguageModel:
    """Fit on the rows given; rows with a null language, id or text are not used."""
    docs = docs.select(
        F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text")
    ).dropna()
    chosen, counts = _sample(docs, bounds)
    word = F.explode(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}]+", " "), " ")).alias("w")
    words = chosen.select("lang", word).where("w != ''").groupBy("lang", "w").count().cache()
    languages = [lang for lang, _ in counts]
    entries, logs = [], []

    def most(frame: DataFrame, number: int) -> None:
        number = bounds.share(number, len(languages))
        rank = Window.partitionBy("lang").orderBy(F.desc("count"), "w")
        rows = frame.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= number).collect()
        total = np.zeros(len(languages))
        at = {lang: i for i, lang in enumerate(languages)}
        for r in rows:
            total[at[r["lang"]]] += r["count"]
        table: dict[str, int] = {}
        for r in rows:
            table.setdefault(r["w"], len(table))
        base = np.log(0.5 / (total + 1.0))
        row = np.array([table[r["w"]] for r in rows], np.int64)
        lang = np.array([at[r["lang"]] for r in rows], np.int64)
        uses = np.array([r["count"] for r in rows], float)
        order = np.argsort(row, kind="stable")
        row, lang, uses = row[order], lang[order], uses[order]
        more = np.log((uses + 0.5) / (total[lang] + 1.0)) - base[lang]
        starts = np.searchsorted(row, np.arange(len(table) + 1))
        log = SparseLogs(base, starts, lang.astype(np.int32), more.astype(np.float32))
        entries.append(table)
        logs.append(log)

    most(words, bounds.words)
    for n in ORDERS:
        padded = F.concat(F.lit(" "), "w", F.lit(" ")) if n > 1 else F.col("w")
        last = F.length(padded) - n + 1
        grams = (
            words.where(last >= 1)
            .select("lang", "count", padded.alias("p"), F.explode(F.sequence(F.lit(1), last)).alias("i"))
            .select("lang", "count", F.substring("p", F.col("i"), F.lit(n)).alias("w"))
            .groupBy("lang", "w").agg(F.sum("count").alias("count"))
        )
        most(grams, bounds.grams)
    words.unpersist()
    rows = np.array([n for _, n in counts], float)
    return LanguageModel(languages, np.log(rows / rows.sum()) if len(rows) else rows, entries, logs)


def found_entries(model: LanguageModel, word: str) -> tuple[int, list[int]] | None:
    """Table and rows that score a word, by backoff; None if nothing of the word is known."""
    row = model.entries[0].get(word)
    if row is not None:
        return 0, [row]
    padded = f" {word} "
    for table, n in enumerate(ORDERS, 1):
        text = padded if n > 1 else word
        get = model.entries[table].get
        rows = [r for i in range(len(text) - n + 1) if (r := get(text[i:i + n])) is not None]
        if rows:
            return table, rows
    return None


class Predictor:
    """Scores texts; the distinct tokens of a batch are scored once and remembered up to a bound."""

    def __init__(self, model: LanguageModel) -> None:
        self.model = model
        self.known: dict[str, int] = {}
        # per token: summed scores of its words, number of scored words, number of letters
        self.rows = np.zeros((1 << 12, len(model.languages) + 2))

    def _learn(self, tokens: list[str]) -> None:
        width, count = len(self.model.languages), len(self.known)
        while count + len(tokens) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        out = self.rows[count:count + len(tokens)]
        out[:] = 0
        # by table: the token of each scored word, how many entries it has, and the entries
        owners: list[list[int]] = [[] for _ in self.model.logs]
        sizes: list[list[int]] = [[] for _ in self.model.logs]
        found: list[list[int]] = [[] for _ in self.model.logs]
        for k, token in enumerate(tokens):
            lowered = token.lower()
            if lowered.isalpha():
                words = (lowered,)
            else:
                words = "".join(c if c.isalpha() else " " for c in lowered).split()
            for word in words:
                out[k, width + 1] += len(word)
                hit = found_entries(self.model, word) if width else None
                if hit:
                    owners[hit[0]].append(k)
                    sizes[hit[0]].append(len(hit[1]))
                    found[hit[0]] += hit[1]
        for log, owner, size, rows in zip(self.model.logs, owners, sizes, found):
            if owner:
                np.add.at(out[:, :width], owner, log.means(np.array(rows), np.array(size)))
                np.add.at(out[:, width], owner, 1)
        self.known.update(zip(tokens, range(count, count + len(tokens))))

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score (0 to 1) per text."""
        width = len(self.model.languages)
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        data, offsets = byte_view(texts)
        total = np.zeros((len(texts), width + 2))
        if len(data):
            inner = ~SPACE[data]
            start = inner.copy()
            start[1:] &= ~inner[:-1]
            begins = offsets[:-1][offsets[:-1] < offsets[1:]]
            start[begins] = True
            starts = np.flatnonzero(start)
            tokens = pa.LargeStringArray.from_buffers(
                len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int64)),
                pa.py_buffer(np.ascontiguousarray(data)),
            ).dictionary_encode()
            names = [t.strip() for t in tokens.dictionary.to_pylist()]
            if len(self.known) + len(names) > min(CACHED_TOKENS, CACHED_NUMBERS // (width + 2)):
                self.known = {}
            self._learn(list(dict.fromkeys(t for t in names if t not in self.known)))
            local = self.rows[list(map(self.known.__getitem__, names))]
            index = tokens.indices.to_numpy()
            owner = np.searchsorted(offsets, starts, "right") - 1
            for k in range(width + 2):
                total[:, k] = np.bincount(owner, weights=local[index, k], minlength=len(texts))
        words, letters = total[:, width], total[:, width + 1]
        if not width:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        # evidence of more than 30 words counts as that of 30; without any the score is 0
        weight = np.minimum(1.0, 30.0 / np.maximum(words, 1.0))
        logit = total[:, :width] * weight[:, None] + self.model.prior
        best = logit.argmax(1)
        share = np.exp(logit - logit.max(1, keepdims=True))
        score = 1.0 / share.sum(1)
        silent = letters == 0
        score[words == 0] = 0.0
        names = [UNKNOWN if s else self.model.languages[b] for s, b in zip(silent.tolist(), best.tolist())]
        return names, np.where(silent, 0.0, score)


def identify(
    docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, lang_pred, score) per row. ``und`` with score 0 if the text is null or has no letter, or if
    nothing was learned. A text without any known word or gram is given the most frequent language with
    score 0. Null and repeated ids are passed on; other columns are not looked at."""

    def run(batches):
        predictor = Predictor(model)
        for batch in batches:
            for part in steps(batch, "text"):
                names, scores = predictor.predict(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    ["id", "lang_pred", "score"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(tidied(run), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_identified(
    docs: DataFrame, model: LanguageModel, text_col: str = "text", least: float = 0.5
) -> DataFrame:
    """The rows, all columns, whose language is found with a score of at least ``least``."""
    at = docs.columns.index(text_col)

    def run(batches):
        predictor = Predictor(model)
        for batch in batches:
            named = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
            for part in steps(named, f"c{at}"):
                names, scores = predictor.predict(part.column(at))
                keep = [n != UNKNOWN and s >= least for n, s in zip(names, scores.tolist())]
                yield part.filter(pa.array(keep, pa.bool_())).rename_columns(batch.schema.names)

    return docs.mapInArrow(tidied(run), docs.schema)
