"""Packing of token ids into sequences: vector bin packing with the dot-product heuristic.

A piece asks for three things at once: tokens, one segment, and loss-bearing tokens (all but its first,
which nothing precedes). A sequence is opened and takes, again and again, the waiting piece that fits
and has the largest dot product with what is left of the limits. Each task packs its own partition from
a bounded pool, so nothing is shuffled.
"""

from __future__ import annotations

import json
import os
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelake.llm.common import byte_view, lists, ragged, steps, tidied

CACHED_CHUNKS = 100_000
POOL = 1024
LONG_PART = 10_000
PLAIN_BLANKS = str.maketrans("", "", " \n\r\t")
# fixed value: the word pattern of byte-level vocabularies
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 256
    loss: int = 1024


def _cut_tables() -> tuple[np.ndarray, np.ndarray]:
    """Bytes that may stand before and after a blank at which a text may be cut.

    Visible ASCII, and parts of characters that no wide blank ends or begins with.
    """
    before, after = np.zeros(256, bool), np.zeros(256, bool)
    before[33:127] = after[33:127] = True
    before[128:192] = after[192:256] = True
    before[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False
    after[[0xC2, 0xE1, 0xE2, 0xE3]] = False
    return before, after


def byte_signs() -> dict[str, int]:
    """The visible signs that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteEncoder:
    """Ids of whole texts as the tokenizers library gives them, without added special tokens.

    A byte-level tokenizer starts a new word at a blank between two visible characters, so the parts
    between such blanks are encoded once each and remembered up to a bound. Parts are encoded many at a
    time by the rank encoder over the same vocabulary and pattern; those with an added token, with odd
    blanks at an end or beyond ``LONG_PART`` bytes (long runs of blanks overflow its pattern) go through
    the tokenizer itself.
    """

    def __init__(self, model: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tiktoken import Encoding

        self.text, self.model = model, None
        spec = json.loads(model)
        signs = byte_signs()
        ranks = {bytes(signs[c] for c in piece): i for piece, i in spec["model"]["vocab"].items()}
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"] or not _merges_in_order(spec):
            raise ValueError("only byte-level models whose ids follow the merges are supported")
        self.ranks = Encoding("ranks", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.size_of = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, i in ranks.items():
            self.size_of[i] = len(piece)
        self.before, self.after = _cut_tables()
        self._clear()

    def _clear(self) -> None:
        # an Arrow array: a tenth of what a dict of strings takes in each worker
        self.known = pa.array([], pa.large_string())
        self.flat = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 12, np.int64)
        self.sizes = np.zeros(1 << 12, np.int64)
        self.used = 0

    def _joinable(self, chunks: pa.Array) -> np.ndarray:
        """Parts that may be encoded in one run with others: the seams are word starts."""
        data, offsets = byte_view(chunks)
        first, last = offsets[:-1], offsets[1:] - 1
        fine = (last > first) & (last - first < LONG_PART) & (data[first] == 32) & self.after[data[np.minimum(first + 1, last)]]
        return fine & (self.before[data[last]] | ((data[last - 1] == 0xC3) & (data[last] >= 128)))

    def _library(self):
        """The tokenizer itself, loaded for the first odd part only."""
        if self.model is None:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_str(self.text)
        return self.model

    def _alone(self, chunk: str) -> list[int]:
        """A part that is not joined."""
        plain = len(chunk) <= LONG_PART and not any(token in chunk for token in self.added) and not any(
            c.isspace() or c < " " for c in chunk.translate(PLAIN_BLANKS)
        )
        if plain:
            return self.ranks.encode_ordinary(chunk)
        return self._library().encode(chunk, add_special_tokens=False).ids

    def _learn(self, chunks: pa.Array) -> None:
        whole = self._joinable(chunks)
        for token in self.added:
            whole &= ~pc.match_substring(chunks, token).to_numpy(zero_copy_only=False)
        inner, first = chunks.filter(pa.array(whole)), chunks.filter(pa.array(~whole))
        data, offsets = byte_view(inner)
        ids, sizes = [], []
        for k in range(0, len(inner), 8192):
            ends = offsets[k + 1:k + 8193]
            run = data[offsets[k]:ends[-1]].tobytes().decode("utf-8")
            got = np.asarray(self.ranks.encode_to_numpy(run)).astype(np.int32)
            at = np.searchsorted(np.cumsum(self.size_of[got]), ends - offsets[k], "left") + 1
            ids.append(got)
            sizes.append(np.diff(at, prepend=0))
        for chunk in first.to_pylist():
            got = np.array(self._alone(chunk), np.int32)
            ids.append(got)
            sizes.append(np.array([len(got)]))
        flat, size = np.concatenate(ids), np.concatenate(sizes)
        count = len(self.known)
        while count + len(chunks) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:self.used + len(flat)] = flat
        self.sizes[count:count + len(chunks)] = size
        self.starts[count:count + len(chunks)] = self.used + np.cumsum(size) - size
        self.used += len(flat)
        self.known = pa.concat_arrays([self.known, inner, first])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, flat, and their number per text. Nulls are empty texts."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        data, offsets = byte_view(texts)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        blank = np.flatnonzero(data[1:-1] == 32) + 1
        blank = blank[self.after[data[blank + 1]]]
        prior = data[blank - 1]
        fine = self.before[prior] | ((prior >= 128) & (blank > 1) & (data[blank - 2] == 0xC3))
        cut = np.zeros(len(data), bool)
        cut[blank[fine]] = True
        ends = offsets[1:-1]
        inside = ends[(ends > 0) & (ends < len(data))]
        cut[inside - 1] = False  # what follows belongs to another text
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(cut)
        chunks = pa.LargeStringArray.from_buffers(
            len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int64)),
            pa.py_buffer(np.ascontiguousarray(data)),
        ).dictionary_encode()
        names = chunks.dictionary
        if len(self.known) + len(names) > CACHED_CHUNKS:
            self._clear()
        fresh = names.filter(pc.invert(pc.is_in(names, value_set=self.known)))
        if len(fresh):
            self._learn(fresh)
        index = pc.index_in(names, value_set=self.known).to_numpy(zero_copy_only=False)
        index = index.astype(np.int64)[chunks.indices.to_numpy()]
        sizes = self.sizes[index]
        ids = self.flat[ragged(self.starts[index], sizes)]
        owner = np.searchsorted(offsets, starts, "right") - 1
        return ids, np.bincount(owner, weights=sizes, minlength=len(texts)).astype(np.int64)


def _merges_in_order(spec: dict) -> bool:
    """Whether every merge makes a piece of the next higher id, so that ids rank the merges."""
    vocab, last = spec["model"]["vocab"], -1
    for merge in spec["model"]["merges"]:
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        if vocab[left + right] <= last:
            return False
        last = vocab[left + right]
    return True


class Packer:
    """Fills sequences from a pool of pieces (key, start, ids, total)."""

    def __init__(self, limits: Limits, base: int, min_cut: int) -> None:
        self.most = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.limit, self.base = limits.tokens, base
        self.min_cut = min(min_cut, limits.tokens, limits.loss + 1)
        self.pool: list[tuple] = []
        self.used = 0
        self.out: list[tuple] = []

    def _sequence(self, pieces: list[tuple]) -> None:
        offset = 0
        for key, start, ids, total in pieces:
            self.out.append((key, start, ids, total, self.base + self.used, offset))
            offset += len(ids)
        self.used += 1

    def add(self, key, ids: np.ndarray) -> None:
        """Whole sequences are cut off at once; the rest waits in the pool."""
        total = len(ids)
        whole = total - total % self.limit
        if self.most[1] >= 1 and self.most[2] >= self.limit - 1:
            for start in range(0, whole, self.limit):
                self._sequence([(key, start, ids[start:start + self.limit], total)])
        else:
            step = int(min(self.limit, self.most[2] + 1))
            whole = total - total % step
            self.pool += [(key, s, ids[s:s + step], total) for s in range(0, whole, step)]
        if whole < total:
            self.pool.append((key, whole, ids[whole:].copy(), total))
        if len(self.pool) >= 2 * POOL:
            self._fill(POOL)

    def finish(self) -> None:
        self._fill(0)

    def _fill(self, keep: int) -> None:
        """Open sequences until only ``keep`` pieces wait."""
        pool = self.pool
        tokens = np.array([len(p[2]) for p in pool], float)
        loss = np.maximum(tokens - 1, 0)
        scale = 1 / self.most**2
        waiting = np.ones(len(pool), bool)
        left_over = len(pool)
        while left_over > keep:
            room, taken = self.most.copy(), []
            while left_over:
                fits = waiting & (tokens <= room[0]) & (loss <= room[2])
                if room[1] >= 1 and fits.any():
                    # dot product of the three asks with the three rooms, each as a share of its limit
                    gain = tokens * (room[0] * scale[0]) + room[1] * scale[1] + loss * (room[2] * scale[2])
                    best = int(np.where(fits, gain, -1.0).argmax())
                    taken.append(pool[best])
                    waiting[best] = False
                    left_over -= 1
                    room -= [tokens[best], 1, loss[best]]
                    continue
                cut = int(min(room[0], room[2] + 1))
                if room[1] < 1 or cut < self.min_cut:
                    break
                best = int(np.where(waiting, tokens, -1.0).argmax())
                key, start, ids, total = pool[best]
                taken.append((key, start, ids[:cut], total))
                pool[best] = (key, start + cut, ids[cut:], total)
                tokens[best] -= cut
                loss[best] = max(tokens[best] - 1, 0)
                break
            if left_over or sum(len(p[2]) for p in taken) == self.limit:
                self._sequence(taken)
            else:
                self._powers(taken)
        self.pool = [p for p, w in zip(pool, waiting) if w]

    def _powers(self, pieces: list[tuple]) -> None:
        """The last, partly filled sequence becomes sequences of power-of-two length: no padding."""
        size, room, taken = sum(len(p[2]) for p in pieces), 0, []
        for key, start, ids, total in pieces:
            while len(ids):
                if not room:
                    room = 1 << (size.bit_length() - 1)
                    size -= room
                part = ids[:room]
                taken.append((key, start, part, total))
                start, ids, room = start + len(part), ids[len(part):], room - len(part)
                if not room:
                    self._sequence(taken)
                    taken = []


def pack_documents(
    docs: DataFrame, path: str, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text",
    end_id: int = 0, min_cut: int = 64, with_ids: bool = True,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A document's ids are those of the tokenizer file at ``path`` followed by ``end_id``; a null or empty
    text has only that. Documents are cut at the token limit; a remainder is cut once more only where no
    waiting piece fits and at least ``min_cut`` tokens are free. A sequence of full or power-of-two
    length needs no padding; the last one of a task is split into such lengths.
    Every row is packed, also with a null or repeated id; other columns are ignored; an empty table
    gives no rows. Sequence ids are unique: partition number and a counter.
    """
    with open(path, encoding="utf-8") as file:
        model = file.read()
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
        + (", ids array<int>" if with_ids else "")
    )

    def rows(id_type: pa.DataType, packed: list[tuple]) -> pa.RecordBatch:
        key, start, ids, total, sequence, offset = zip(*packed)
        columns = [
            pa.array(key, id_type), pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()),
            pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
            pa.array(total, pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()),
        ]
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            columns.append(lists(np.concatenate(ids), np.array([len(x) for x in ids]), pa.int32()))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches):
        encoder, id_type = ByteEncoder(model), None
        packer = Packer(limits, TaskContext.get().partitionId() << 33, min_cut)
        for batch in batches:
            id_type = batch.schema.field("id").type
            for part in steps(batch, "text"):
                ids, counts = encoder.encode(part.column("text"))
                at = 0
                for key, count in zip(part.column("id").to_pylist(), counts.tolist()):
                    packer.add(key, np.append(ids[at:at + count], np.int32(end_id)))
                    at += count
                if packer.out:
                    yield rows(id_type, packer.out)
                    packer.out = []
        packer.finish()
        if packer.out:
            yield rows(id_type, packer.out)

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(tidied(run), schema).withColumnRenamed("id", id_col)
