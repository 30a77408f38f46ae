"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The distinct words of a batch lie as flat symbol arrays. Each round finds the best pair rank of every
word at once, merges its leftmost pairs, closes the gaps and retires words without a pair. A piece
that better pieces could grow from ("unsafe"), or whose score it shares with others, is merged once a
round, all other pieces at every place of the word; so the order is that of the one-by-one algorithm.
Words beyond ``LONG_WORD`` signs would take too many rounds and are merged from a heap instead.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
from array import array
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelake.llm.common import byte_view, lists, ragged, steps

NEVER = np.int32(2**31 - 1)
CACHED_WORDS = 200_000
LONG_WORD = 2000
MARK = "▁"


@dataclass
class PieceTable:
    """A piece model as arrays; small enough (a few MB) to travel with a task."""

    text: list[str]          # by id; control pieces are empty
    first_byte: int          # id of the byte piece 0
    unknown: int
    chars: dict[int, int]    # code point to symbol
    symbols: int             # number of symbols; those from len(text) on are characters without id
    keys: np.ndarray         # sorted left * (symbols + 1) + right
    made: np.ndarray         # the piece of each key
    rank: np.ndarray         # by id, 0 is best
    safe: np.ndarray         # by id
    tied: np.ndarray         # by key: pieces of blanks only that share the last score
    block: int               # a run of blanks is tiled from the left by pieces of this size

    @cached_property
    def merges(self) -> dict[int, int]:
        """Piece by key, but for those of blanks."""
        return dict(zip(self.keys[~self.tied].tolist(), self.made[~self.tied].tolist()))


def load_table(path: str) -> PieceTable:
    """Read a SentencePiece BPE model with byte fallback, dummy prefix and identity normalisation."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))]
    if model.piece_to_id("<0x00>") == model.unk_id() or any(model.is_unused(i) for i in plain):
        raise ValueError("only models with byte pieces and without unused pieces are supported")
    if model.normalize("a  B ﬁ ") != MARK + "a" + 2 * MARK + "B ﬁ" + MARK:
        raise ValueError("only models with identity normalisation and a dummy prefix are supported")
    text = ["" if model.is_control(i) else model.id_to_piece(i) for i in ids]
    if any(MARK in text[i].lstrip(MARK) for i in plain):
        raise ValueError("pieces that cross a word border are not supported")
    symbol = {text[i]: i for i in plain}
    for ch in sorted({c for i in plain for c in text[i]} - set(symbol)):
        symbol[ch] = len(ids) + len(symbol) - len(plain)
    score = np.array([model.get_score(i) for i in ids])
    levels, rank = np.unique(-score[plain], return_inverse=True)
    ranks = np.full(len(ids), NEVER, np.int32)
    ranks[plain] = rank
    shared = np.bincount(rank)[rank] > 1
    last = len(levels) - 1
    blanks = {
        i for i, s, r in zip(plain, shared, rank)
        if s and r == last and len(text[i]) > 1 and not text[i].strip(MARK)
    }
    safe = np.ones(len(ids), bool)
    safe[[i for i, s in zip(plain, shared) if s]] = False
    wide = len(ids) + len(symbol) - len(plain) + 1
    found = []
    for i in plain:
        for cut in range(1, len(text[i])):
            left, right = symbol.get(text[i][:cut]), symbol.get(text[i][cut:])
            if left is None or right is None:
                continue
            found.append((left * wide + right, i))
            for part in (left, right):
                if part < len(ids) and ranks[i] <= ranks[part]:
                    safe[part] = False
            if i not in blanks and (left in blanks or right in blanks):
                blanks = set()  # blanks could grow into words: no phase of their own
    found.sort()
    keys, made = (np.array(x, np.int64) for x in zip(*found))
    table = PieceTable(
        text, model.piece_to_id("<0x00>"), model.unk_id(),
        {ord(s): i for s, i in symbol.items() if len(s) == 1}, wide - 1, keys, made, ranks, safe,
        np.isin(made, list(blanks)), 0,
    )
    if blanks:
        most = max(len(text[i]) for i in blanks)
        run = np.full(2 * most, symbol[MARK], np.int64)
        tiles, _, _ = _rounds(table, run, run.copy(), np.array([2 * most]), True)
        if [len(text[i]) for i in tiles] == [most, most]:
            table.block = most
    return table


def _pairs(table: PieceTable, left: np.ndarray, right: np.ndarray, blanks: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rank and piece of pairs of symbols; ``NEVER`` and 0 where they make none."""
    rank, piece = np.full(len(left), NEVER, np.int32), np.zeros(len(left), np.int64)
    key = left * (table.symbols + 1) + right
    place = np.minimum(np.searchsorted(table.keys, key), len(table.keys) - 1)
    hit = np.flatnonzero((table.keys[place] == key) & (table.tied[place] == blanks))
    piece[hit] = table.made[place[hit]]
    rank[hit] = table.rank[piece[hit]]
    return rank, piece


def _heaped(table: PieceTable, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge one long word pair by pair from a heap of rank and place: the places left, and their symbols.

    A round of merges looks at the whole word, so a word of n symbols that merges one pair a round would
    take n * n steps; here it takes n * log(n).
    """
    n, wide = len(symbols), table.symbols + 1
    merge, rank_of = table.merges, table.rank.tolist()
    first, _ = _pairs(table, symbols[:-1], symbols[1:], False)
    open_ = np.flatnonzero(first < NEVER)
    heap = (first[open_].astype(np.int64) * n + open_).tolist()
    heapq.heapify(heap)
    symbol, after, before = (array("q", x) for x in (symbols.tolist(), range(1, n + 1), range(-1, n - 1)))
    gone = bytearray(n)
    while heap:
        rank, at = divmod(heapq.heappop(heap), n)
        right = after[at]
        if gone[at] or right == n:
            continue
        made = merge.get(symbol[at] * wide + symbol[right])
        if made is None or rank_of[made] != rank:
            continue  # one of the two has been merged meanwhile
        symbol[at], gone[right] = made, 1
        after[at] = follow = after[right]
        if follow < n:
            before[follow] = at
            fresh = merge.get(made * wide + symbol[follow])
            if fresh is not None:
                heapq.heappush(heap, rank_of[fresh] * n + at)
        lead = before[at]
        if lead >= 0:
            fresh = merge.get(symbol[lead] * wide + made)
            if fresh is not None:
                heapq.heappush(heap, rank_of[fresh] * n + lead)
    left = np.flatnonzero(np.frombuffer(gone, np.uint8) == 0)
    return left, np.array(symbol, np.int64)[left]


def _long_words(
    table: PieceTable, symbols: np.ndarray, points: np.ndarray, lengths: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same words, those beyond ``LONG_WORD`` symbols merged already."""
    ends, keep, lengths = np.cumsum(lengths), np.ones(len(symbols), bool), lengths.copy()
    symbols = symbols.copy()
    for word in np.flatnonzero(lengths > LONG_WORD).tolist():
        stop = ends[word]
        start = stop - lengths[word]
        left, made = _heaped(table, symbols[start:stop])
        keep[start:stop] = False
        keep[start + left] = True
        symbols[start + left] = made
        lengths[word] = len(left)
    return symbols[keep], points[keep], lengths


def _rounds(
    table: PieceTable, symbols: np.ndarray, points: np.ndarray, lengths: np.ndarray, blanks: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge until no pair remains. Returns symbols, code points and lengths in the words' order.

    ``blanks`` chooses between the pairs of blank runs and all others.
    """
    word = np.repeat(np.arange(len(lengths)), lengths)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def pairs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of the pairs that start at these places."""
        rank, piece = np.full(len(at), NEVER, np.int32), np.zeros(len(at), np.int64)
        inner = np.flatnonzero(at + 1 < len(symbols))
        inner = inner[word[at[inner]] == word[at[inner] + 1]]
        rank[inner], piece[inner] = _pairs(table, symbols[at[inner]], symbols[at[inner] + 1], blanks)
        return rank, piece

    rank, piece = pairs(np.arange(len(symbols)))
    while len(symbols):
        fresh = np.ones(len(symbols), bool)
        fresh[1:] = word[1:] != word[:-1]
        starts = np.flatnonzero(fresh)
        sizes = np.diff(np.append(starts, len(symbols)))
        best = np.minimum.reduceat(rank, starts)
        open_ = np.repeat(best < NEVER, sizes)
        if not open_.all():
            shut = ~open_
            done.append((word[shut], symbols[shut], points[shut]))
            word, symbols, points, rank, piece = (x[open_] for x in (word, symbols, points, rank, piece))
            sizes, best = sizes[best < NEVER], best[best < NEVER]
            if not len(symbols):
                break
        at = np.flatnonzero(rank == np.repeat(best, sizes))
        # overlapping candidates: every second one of a run, from the left
        head = np.ones(len(at), bool)
        head[1:] = np.diff(at) > 1
        first = np.flatnonzero(head)
        step = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        leading = np.ones(len(at), bool)
        leading[1:] = word[at[1:]] != word[at[:-1]]
        at = at[leading | (table.safe[piece[at]] & (step % 2 == 0))]
        symbols[at] = piece[at]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        moved = (np.cumsum(keep) - 1)[at]
        word, symbols, points, rank, piece = (x[keep] for x in (word, symbols, points, rank, piece))
        touched = np.unique(np.concatenate([moved, moved[moved > 0] - 1]))
        rank[touched], piece[touched] = pairs(touched)
    if not done:
        return symbols, points, lengths
    word, symbols, points = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(word, kind="stable")
    return symbols[order], points[order], np.bincount(word, minlength=len(lengths))


class Encoder:
    """Encodes string arrays; remembers the words of earlier batches up to a bound."""

    def __init__(self, table: PieceTable) -> None:
        self.table = table
        self.symbol_of = np.full(0x110000, -1, np.int64)
        for point, symbol in table.chars.items():
            self.symbol_of[point] = symbol
        self.symbol_of[32] = self.symbol_of[ord(MARK)]
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 12, np.int64)
        self.sizes = np.zeros(1 << 12, np.int64)
        self.used = 0

    def _learn(self, words: list[str]) -> None:
        ids, sizes = self._merged(words)
        count = len(self.known)
        while count + len(words) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:self.used + len(ids)] = ids
        self.sizes[count:count + len(words)] = sizes
        self.starts[count:count + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        for k, word in enumerate(words):
            self.known[word] = count + k

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        table = self.table
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.symbol_of[points]
        if (lengths > LONG_WORD).any():
            symbols, points, lengths = _long_words(table, symbols, points, lengths)
        symbols, points, lengths = _rounds(table, symbols, points, lengths, False)
        if table.tied.any():
            symbols, points, lengths = self._tiled(symbols, points, lengths)
        # what is no piece becomes bytes
        odd = np.flatnonzero((symbols < 0) | (symbols >= len(table.text)))
        if not len(odd):
            return symbols.astype(np.int32), lengths
        raw = [chr(c).encode("utf-8") for c in points[odd].tolist()]
        width = np.ones(len(symbols), np.int64)
        width[odd] = [len(x) for x in raw]
        out = np.repeat(symbols, width)
        at = ragged((np.cumsum(width) - width)[odd], width[odd])
        out[at] = table.first_byte + np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        lengths = np.bincount(np.repeat(owner, width), minlength=len(lengths))
        return out.astype(np.int32), lengths

    def _tiled(self, symbols, points, lengths):
        """Merge runs of blanks, cut where a full tile ends."""
        blank = symbols == self.symbol_of[32]
        owner = np.repeat(np.arange(len(lengths)), lengths)
        if not (blank[1:] & blank[:-1]).any():
            return symbols, points, lengths
        fresh = np.ones(len(symbols), bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (blank[1:] != blank[:-1])
        starts = np.flatnonzero(fresh)
        sizes = np.diff(np.append(starts, len(symbols)))
        if self.table.block:
            inside = np.arange(len(symbols)) - np.repeat(starts, sizes)
            fresh |= blank & (inside % self.table.block == 0)
            starts = np.flatnonzero(fresh)
            sizes = np.diff(np.append(starts, len(symbols)))
        words_of = owner[starts]
        symbols, points, sizes = _rounds(self.table, symbols, points, sizes, True)
        return symbols, points, np.bincount(np.repeat(words_of, sizes), minlength=len(lengths))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, flat, and their number per text. Nulls are empty texts."""
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), MARK, " ")
        empty = pc.equal(texts, "")
        texts = pc.if_else(empty, texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
        data, offsets = byte_view(texts)
        blank = data == 32
        border = blank.copy()
        border[1:] &= ~blank[:-1]
        border[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(border)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        ends = np.append(starts, len(data)).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(
            len(starts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))
        ).dictionary_encode()
        names = words.dictionary.to_pylist()
        if len(self.known) + len(names) > CACHED_WORDS and self.known:
            self._clear()
        fresh = [w for w in names if w not in self.known]
        if fresh:
            self._learn(fresh)
        index = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        index = index[words.indices.to_numpy()]
        sizes = self.sizes[index]
        ids = self.flat[ragged(self.starts[index], sizes)]
        text_of = np.searchsorted(offsets, starts, "right") - 1
        counts = np.bincount(text_of, weights=sizes, minlength=len(texts)).astype(np.int64)
        return ids, counts


def _one_by_one(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


class Decoder:
    """Turns ids back into text."""

    def __init__(self, table: PieceTable) -> None:
        self.piece = np.empty(len(table.text), object)
        for i, text in enumerate(table.text):
            self.piece[i] = text.replace(MARK, " ").encode("utf-8")
        for b in range(256):
            self.piece[table.first_byte + b] = bytes([b])
        self.piece[table.unknown] = " ⁇ ".encode()
        self.marked = np.array([t.startswith(MARK) for t in table.text])
        self.silent = np.array([not t for t in table.text])
        codecs.register_error("each-byte", _one_by_one)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        out, start = [], 0
        for count in counts.tolist():
            own = ids[start:start + count]
            start += count
            mute = self.silent[own]
            parts = np.split(own, np.flatnonzero(mute)) if mute.any() else [own]
            text = "".join(
                b"".join(self.piece[part].tolist()).decode("utf-8", "each-byte") for part in parts
            )
            heard = own[~mute][:1]
            out.append(text[1:] if len(heard) and self.marked[heard[0]] else text)
        return out


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the piece ids of every whole text, as the library encodes without begin or end ids.

    Null and empty texts give an empty list; null, repeated and clashing ids are passed on.
    """
    table = load_table(path)

    def run(batches):
        encoder = Encoder(table)
        for batch in batches:
            for part in steps(batch, "text"):
                ids, counts = encoder.encode(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), lists(ids, counts, pa.int32())], ["id", "ids"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_pieces(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text of every list of ids; a null or empty list gives an empty text."""
    table = load_table(path)

    def run(batches):
        decoder = Decoder(table)
        for batch in batches:
            rows = batch.column("ids").fill_null([])
            counts = pc.list_value_length(rows).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = decoder.decode(rows.flatten().to_numpy(zero_copy_only=False), counts)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    chosen = encoded.select(F.col(id_col).alias("id"), F.coalesce(ids_col, F.array().cast("array<int>")).alias("ids"))
    return chosen.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def piece_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass, digests only."""
    table = load_table(path)

    def run(batches):
        encoder, decoder = Encoder(table), Decoder(table)
        decimal = np.array([str(i) for i in range(len(table.text))], object)
        for batch in batches:
            for part in steps(batch, "text"):
                ids, counts = encoder.encode(part.column("text"))
                ends = np.cumsum(counts)
                listed = [
                    hashlib.sha256(",".join(decimal[ids[e - n:e]].tolist()).encode()).hexdigest()
                    for n, e in zip(counts.tolist(), ends.tolist())
                ]
                spoken = [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in decoder.decode(ids, counts)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(counts), pa.array(listed), pa.array(spoken)],
                    ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(
        run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    ).withColumnRenamed("id", id_col)
