"""Alignment of two tokenizers' ids by the byte places at which tokens of both end.

The cumulative byte ends of both id lists of a text become dictionaries from end to index. The common keys
of the two, sorted, are the places where both have a border: they slice both lists into groups. Within a
group, each two tokens whose bytes overlap are linked. How often an id pair is linked in the whole corpus is
counted over blocks of documents: a block holds each of its pairs once, so what is shuffled is the pairs
of the blocks and not the links.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelake.llm.common import byte_view, lists, ragged, saved, steps, tidied
from quotelake.llm.packing import ByteEncoder, byte_signs

BLOCK_BYTES = 8 << 20
ENDS, PARTS = (",", "|"), (",", ";")


class PlainEncoder(ByteEncoder):
    """Ids of a byte-level tokenizer file that takes the strings of special tokens for ordinary text."""

    def __init__(self, model: str) -> None:
        super().__init__(model)
        self.added = []

    def _library(self):
        library = super()._library()
        library.encode_special_tokens = True
        return library


@dataclass
class Aligned:
    """The tokens of the texts of a step, flat over its texts, and where groups end in both lists."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray       # per text, as the next two
    n_b: np.ndarray
    n_groups: np.ndarray
    cut_a: np.ndarray     # per group: the number of tokens up to its end, counted over the whole step
    cut_b: np.ndarray
    ends_a: np.ndarray    # per token: its byte end, counted over the whole step
    ends_b: np.ndarray

    def starts(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.concatenate([[0], cut]).astype(np.int64)[:-1] for cut in (self.cut_a, self.cut_b))


class Aligner:
    """Encodes texts with a byte-level tokenizer (A) and a piece model (B) and aligns their ids."""

    def __init__(self, byte_model: str, piece_model: bytes) -> None:
        import sentencepiece

        self.left = PlainEncoder(byte_model)
        self.right = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        signs, vocabulary = byte_signs(), json.loads(byte_model)["model"]["vocab"]
        left = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            left[i] = bytes(signs[c] for c in piece) if all(c in signs for c in piece) else piece.encode("utf-8")
        right = [self._bytes(i) for i in range(self.right.get_piece_size())]
        self.bytes_a, self.bytes_b = (pa.array(x, pa.large_binary()) for x in (left, right))
        self.size_a, self.size_b = (np.array([len(x) for x in y], np.int64) for y in (left, right))
        self.written_a, self.written_b = (
            pa.array([f"{i}{mark}" for mark in marks for i in range(n)], pa.large_binary())
            for marks, n in ((ENDS, len(left)), (PARTS, len(right)))
        )
        self.written = pa.concat_arrays([self.written_a, self.written_b])

    def _bytes(self, i: int) -> bytes:
        piece = self.right.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.right.is_byte(i) else piece.replace("▁", " ").encode("utf-8")

    def _same(self, texts: pa.Array, table: pa.Array, size: np.ndarray, ids: np.ndarray, counts: np.ndarray):
        """Whether the joined token bytes of each text are the text."""
        want, ends = byte_view(texts)
        taken = table.take(pa.array(ids))
        _, places, data = taken.buffers()
        got = np.frombuffer(data, np.uint8) if data is not None and len(ids) else np.zeros(0, np.uint8)
        total = np.concatenate([[0], np.cumsum(size[ids])])[np.concatenate([[0], np.cumsum(counts)])]
        got = got[:total[-1]]
        if np.array_equal(total, ends) and np.array_equal(got, want):
            return np.ones(len(texts), bool)
        a, b = memoryview(np.ascontiguousarray(got)), memoryview(np.ascontiguousarray(want))
        return np.array([
            a[p:q] == b[s:t] for p, q, s, t in zip(
                total[:-1].tolist(), total[1:].tolist(), ends[:-1].tolist(), ends[1:].tolist()
            )
        ], bool)

    def align(self, texts: pa.Array) -> Aligned:
        """Tokens and groups of the texts. Null and empty texts, and texts that either tokenizer does not
        give back byte for byte, have none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        full = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
        a, n_a = self.left.encode(spaced)
        pieces = self.right.encode(texts.to_pylist(), num_threads=1)
        n_b = np.fromiter(map(len, pieces), np.int64, len(pieces))
        b = np.fromiter(chain.from_iterable(pieces), np.int64, int(n_b.sum()))
        a = a.astype(np.int64)
        full &= self._same(spaced, self.bytes_a, self.size_a, a, n_a)
        full &= self._same(spaced, self.bytes_b, self.size_b, b, n_b)
        a, b = a[np.repeat(full, n_a)], b[np.repeat(full, n_b)]
        n_a, n_b = np.where(full, n_a, 0), np.where(full, n_b, 0)
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        cut_a, cut_b, groups = [], [], np.zeros(len(full), np.int64)
        at_a = at_b = 0
        for k, (p, q) in enumerate(zip(n_a.tolist(), n_b.tolist())):
            if p:
                index_a = dict(zip(ends_a[at_a:at_a + p].tolist(), range(at_a + 1, at_a + p + 1)))
                index_b = dict(zip(ends_b[at_b:at_b + q].tolist(), range(at_b + 1, at_b + q + 1)))
                common = sorted(index_a.keys() & index_b.keys())
                cut_a += map(index_a.__getitem__, common)
                cut_b += map(index_b.__getitem__, common)
                groups[k] = len(common)
                at_a, at_b = at_a + p, at_b + q
        return Aligned(a, b, n_a, n_b, groups, np.array(cut_a, np.int64), np.array(cut_b, np.int64), ends_a, ends_b)

    @staticmethod
    def links(found: Aligned) -> tuple[np.ndarray, np.ndarray]:
        """Places in the two flat id lists of all linked pairs, slice by slice of each kind.

        With one token on a side, all pairs of the slice overlap. Otherwise each stretch between two
        neighbouring borders of either list lies in one token of both, and is the overlap of one pair.
        """
        start_a, start_b = found.starts()
        size_a, size_b = found.cut_a - start_a, found.cut_b - start_b
        plain = np.minimum(size_a, size_b) == 1
        most = np.maximum(size_a, size_b)[plain]
        step = ragged(np.zeros(len(most), np.int64), most)
        la = np.repeat(start_a[plain], most) + np.where(np.repeat(size_a[plain] > 1, most), step, 0)
        lb = np.repeat(start_b[plain], most) + np.where(np.repeat(size_b[plain] > 1, most), step, 0)
        in_a, in_b = (ragged(s[~plain], n[~plain]) for s, n in ((start_a, size_a), (start_b, size_b)))
        ends_a, ends_b = found.ends_a[in_a], found.ends_b[in_b]
        borders = np.union1d(ends_a, ends_b)
        return (
            np.concatenate([la, in_a[np.searchsorted(ends_a, borders)]]),
            np.concatenate([lb, in_b[np.searchsorted(ends_b, borders)]]),
        )

    def written_groups(self, found: Aligned):
        """Per text, the groups as ``a1,a2|b1;a3|b2,b3`` in bytes; empty without tokens."""
        start_a, start_b = found.starts()
        size_a, size_b = found.cut_a - start_a, found.cut_b - start_b
        last_a, last_b = np.zeros(len(found.a), np.int64), np.zeros(len(found.b), np.int64)
        last_a[found.cut_a - 1], last_b[found.cut_b - 1] = len(self.size_a), len(self.size_b)
        order = np.empty(len(found.a) + len(found.b), np.int64)
        order[np.arange(len(found.a)) + np.repeat(start_b, size_a)] = found.a + last_a
        order[np.arange(len(found.b)) + np.repeat(found.cut_a, size_b)] = found.b + last_b + 2 * len(self.size_a)
        taken = self.written.take(pa.array(order))
        _, places, data = taken.buffers()
        ends = np.frombuffer(places, np.int64)[np.concatenate([[0], np.cumsum(found.n_a + found.n_b)])].tolist()
        view = memoryview(data) if data is not None else memoryview(b"")
        for start, end in zip(ends, ends[1:]):
            yield view[start:max(end - 1, start)]


def _models(byte_path: str, piece_path: str) -> tuple[str, bytes]:
    with open(byte_path, encoding="utf-8") as left, open(piece_path, "rb") as right:
        return left.read(), right.read()


def align_groups(
    docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, groups): per text the array of (a, b), the ids of both tokenizers in each group.

    A is the byte-level tokenizer file on a blank and the text, B the piece model, which puts that blank
    itself. Null and empty texts, and texts that either does not give back, have no groups. Every row
    gives a row; null, repeated and clashing ids are passed on; other columns are ignored.
    """
    models, kind = _models(byte_path, piece_path), docs.schema[id_col].dataType.simpleString()

    def run(batches):
        aligner = Aligner(*models)
        for batch in batches:
            for part in steps(batch, "text"):
                found = aligner.align(part.column("text"))
                start_a, start_b = found.starts()
                sides = [lists(found.a, found.cut_a - start_a, pa.int32()), lists(found.b, found.cut_b - start_b, pa.int32())]
                ends = np.concatenate([[0], np.cumsum(found.n_groups)]).astype(np.int32)
                groups = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(sides, ["a", "b"]))
                yield pa.RecordBatch.from_arrays([part.column("id"), groups], ["id", "groups"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(
        tidied(run), f"id {kind}, groups array<struct<a:array<int>,b:array<int>>>"
    ).withColumnRenamed("id", id_col)


def _packed(values: np.ndarray) -> bytes:
    """Small numbers, byte plane by byte plane, compressed."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpacked(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4").astype(np.int64)


class _Block:
    """Documents with the id pairs they link: each pair once per document, with how often."""

    def __init__(self, width: int) -> None:
        self.width = width  # a pair is written as a * width + b
        self.size = 0
        self.columns: list[list] = [[] for _ in range(6)]
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.per_doc: list[np.ndarray] = []

    def add(self, ids: pa.Array, found: Aligned, digests: list[str], size: int) -> None:
        la, lb = Aligner.links(found)
        doc = np.repeat(np.arange(len(ids)), found.n_a)[la]
        n_links = np.bincount(doc, minlength=len(ids))
        scale = int(found.a.max(initial=0) + 1) * self.width
        codes, times = np.unique(doc * scale + found.a[la] * self.width + found.b[lb], return_counts=True)
        self.pairs.append(codes % scale)
        self.times.append(times)
        self.per_doc.append(np.bincount(codes // scale, minlength=len(ids)))
        for column, more in zip(self.columns, (
            ids.to_pylist(), found.n_a.tolist(), found.n_b.tolist(), found.n_groups.tolist(), n_links.tolist(), digests,
        )):
            column += more
        self.size += size

    def row(self, block: int, id_type: pa.DataType) -> pa.RecordBatch:
        pairs, index = np.unique(np.concatenate(self.pairs), return_inverse=True)
        times = np.concatenate(self.times)
        counts = np.bincount(index, weights=times, minlength=len(pairs)).astype(np.int64)
        kinds = [id_type, *[pa.int64()] * 4, pa.string()]
        columns = [pa.array([c], pa.list_(t)) for c, t in zip(self.columns, kinds)] + [
            pa.array([pairs], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())),
            pa.array([_packed(x) for x in (np.concatenate(self.per_doc),)], pa.binary()),
            pa.array([_packed(np.diff(index, prepend=0).astype(np.int64) & 0xFFFFFFFF)], pa.binary()),
            pa.array([_packed(times)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *columns], BLOCK_COLUMNS)


DOC_COLUMNS = ["ids", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
BLOCK_COLUMNS = ["block", *DOC_COLUMNS, "pairs", "counts", "per_doc", "steps", "times"]


def link_blocks(
    docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per block of documents (some ``block_bytes`` of text, or one longer text), saved.

    It holds the counts and digests of its documents, its distinct id pairs with their links, and, packed,
    which document links which of these pairs how often.
    """
    models, kind = _models(byte_path, piece_path), docs.schema[id_col].dataType.simpleString()

    def run(batches):
        aligner = Aligner(*models)
        width, number, block = len(aligner.size_b), TaskContext.get().partitionId() << 33, None
        for batch in batches:
            id_type = batch.schema.field("id").type
            for part in steps(batch, "text"):
                found = aligner.align(part.column("text"))
                marks = [
                    hashlib.sha256(text).hexdigest() if n else ""
                    for text, n in zip(aligner.written_groups(found), found.n_a.tolist())
                ]
                block = block or _Block(width)
                block.add(part.column("id"), found, marks, int(byte_view(part.column("text"))[1][-1]))
                if block.size >= block_bytes:
                    yield block.row(number, id_type)
                    number, block = number + 1, None
        if block is not None:
            yield block.row(number, id_type)

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return saved(chosen.mapInArrow(
        tidied(run), f"block long, ids array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, "
        "n_links array<long>, groups_sha256 array<string>, pairs array<long>, counts array<long>, "
        "per_doc binary, steps binary, times binary",
    ), "link-blocks")


def pair_counts(blocks: DataFrame, width: int) -> DataFrame:
    """(pair, total, best): links of every id pair in the whole corpus, and whether no pair of the same
    B id has more. A pair is a * width + b."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    totals = saved(
        each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("total")), "pair-totals"
    ).withColumn("b", F.col("pair") % width)
    most = totals.groupBy("b").agg(F.max("total").alias("most"))
    return totals.join(most, "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def alignment_counts(
    docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``.

    n_best counts the links whose id pair no other pair of the same B id surpasses in the corpus,
    count_sum adds the corpus counts of all links; groups_sha256 is of the groups as decimal ids. See
    ``align_groups`` for the groups and for rows without tokens: these have zeros and an empty string.
    An empty table gives no rows. Repeated rows are counted each.
    """
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=piece_path).get_piece_size()
    kind = docs.schema[id_col].dataType.simpleString()
    blocks = link_blocks(docs, byte_path, piece_path, id_col, text_col, block_bytes)
    asked = blocks.select("block", F.explode("pairs").alias("pair"))
    looked = (
        asked.join(pair_counts(blocks, width), "pair").groupBy("block")
        .agg(F.sort_array(F.collect_list(F.struct("pair", "total", "best"))).alias("found"))  # a block's pairs
        .select("block", F.col("found.total").alias("totals"), F.col("found.best").alias("bests"))
    )

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                docs_of, totals, bests = row["ids"].values, row["totals"].values, row["bests"].values
                per_doc, times = _unpacked(row["per_doc"].as_py()), _unpacked(row["times"].as_py())
                index = np.cumsum(_unpacked(row["steps"].as_py()).astype(np.uint32).view(np.int32), dtype=np.int64)
                owner = np.repeat(np.arange(len(docs_of)), per_doc)
                sums = np.zeros((2, len(docs_of)), np.int64)
                if len(index):
                    np.add.at(sums[0], owner, times * bests.to_numpy(zero_copy_only=False)[index])
                    np.add.at(sums[1], owner, times * totals.to_numpy(zero_copy_only=False)[index])
                yield pa.RecordBatch.from_arrays(
                    [docs_of, *[row[c].values for c in DOC_COLUMNS[1:5]], pa.array(sums[0]), pa.array(sums[1]),
                     row["groups_sha256"].values],
                    ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
                )

    empty = F.array().cast("array<long>")
    rows = blocks.drop("pairs", "counts").join(looked, "block", "left").withColumns({
        "totals": F.coalesce("totals", empty), "bests": F.coalesce("bests", F.array().cast("array<boolean>")),
    })
    return rows.mapInArrow(
        tidied(run), f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
        "groups_sha256 string",
    ).withColumnRenamed("id", id_col)
