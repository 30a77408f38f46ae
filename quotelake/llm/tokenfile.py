"""Token id files: independent zstandard frames, a trailing seek table, a checksum for every frame.

A file is a valid zstandard stream in the public seekable layout. Its frames are

* data frames: ids as little-endian unsigned 32-bit numbers. A frame holds whole documents; a document
  longer than a frame has frames of its own,
* directory frames: (id, whether it is null, number of ids) of every document in order,
* one trailer frame: how many data frames, ids and documents there are,
* the seek table, a skippable frame: compressed size, plain size and checksum (low 32 bits of XXH64 of
  the plain bytes) of every frame before it.

A reader fetches the table from the end of the file and then only the frames it needs. Files are written
by the tasks under names of their attempt; a file counts only once the committed manifest lists it, so a
task that is lost or runs twice leaves nothing behind that would be read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotelake.llm.common import lists, saved, shared_path, steps, tidied
from quotelake.llm.packing import ByteEncoder

FRAME_IDS = 1 << 16
FILE_IDS = 1 << 26
ROWS = 4096
TASK_BYTES = 1 << 26
# fixed values: the skippable frame and the end mark of the public seekable layout
TABLE_MAGIC, END_MAGIC, WITH_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
FOOTER, HEAD, TRAILER = "<IBI", "<II", "<8sQQQ"
HEAD_SIZE, FOOTER_SIZE = struct.calcsize(HEAD), struct.calcsize(FOOTER)
ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])
DOCUMENT = np.dtype([("id", "<i8"), ("null", "u1"), ("size", "<u4")])
NAME = b"tokens/1"


def _file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path)


def _check(plain: bytes) -> int:
    return xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF


class TokenWriter:
    """Appends documents to one file; holds one frame and the directory of that file."""

    def __init__(self, path: str, frame_ids: int = FRAME_IDS, level: int = 3) -> None:
        system, inner = _file_system(path)
        system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        self.out = system.open_output_stream(inner, compression=None)
        self.path, self.frame_ids = path, frame_ids
        self.packer = zstandard.ZstdCompressor(level=level)
        self.waiting: list[np.ndarray] = []
        self.held = self.ids = 0
        self.entries: list[tuple[int, int, int]] = []
        self.documents: list[tuple[int, int, int]] = []

    def _frame(self, plain: bytes) -> None:
        packed = self.packer.compress(plain)
        self.out.write(packed)
        self.entries.append((len(packed), len(plain), _check(plain)))

    def _flush(self) -> None:
        if self.held:
            self._frame(np.concatenate(self.waiting).astype("<u4").tobytes())
        self.waiting, self.held = [], 0

    def add(self, key: int | None, ids: np.ndarray) -> None:
        if self.held + len(ids) > self.frame_ids:
            self._flush()
        for at in range(0, len(ids), self.frame_ids):
            part = ids[at:at + self.frame_ids]
            self.waiting.append(part)
            self.held += len(part)
            if len(ids) > self.frame_ids:
                self._flush()
        self.documents.append((key or 0, key is None, len(ids)))
        self.ids += len(ids)

    def close(self) -> None:
        self._flush()
        data = len(self.entries)
        directory = np.array(self.documents, DOCUMENT).tobytes()
        step = DOCUMENT.itemsize * self.frame_ids
        for at in range(0, len(directory), step):
            self._frame(directory[at:at + step])
        self._frame(struct.pack(TRAILER, NAME, data, self.ids, len(self.documents)))
        table = np.array(self.entries, ENTRY).tobytes() + struct.pack(FOOTER, len(self.entries), WITH_CHECKSUMS, END_MAGIC)
        self.out.write(struct.pack(HEAD, TABLE_MAGIC, len(table)) + table)
        self.out.close()


class TokenFile:
    """Random access to one file. Every frame that is read is checked; a wrong one raises ValueError."""

    def __init__(self, path: str) -> None:
        system, inner = _file_system(path)
        self.path, self.file = path, system.open_input_file(inner)
        self.unpacker = zstandard.ZstdDecompressor()
        self.frames_read = 0
        size = self.file.size()
        if size < HEAD_SIZE + FOOTER_SIZE:
            raise ValueError(f"{path}: no seek table")
        count, kind, mark = struct.unpack(FOOTER, self._bytes(size - FOOTER_SIZE, FOOTER_SIZE))
        length = count * ENTRY.itemsize + FOOTER_SIZE
        start = size - length - HEAD_SIZE
        if mark != END_MAGIC or kind != WITH_CHECKSUMS or start < 0:
            raise ValueError(f"{path}: no seek table")
        if struct.unpack(HEAD, self._bytes(start, HEAD_SIZE)) != (TABLE_MAGIC, length):
            raise ValueError(f"{path}: damaged seek table")
        self.table = np.frombuffer(self._bytes(start + HEAD_SIZE, length - FOOTER_SIZE), ENTRY)
        self.places = np.concatenate([[0], np.cumsum(self.table["packed"], dtype=np.int64)])
        if not count or self.places[-1] != start:
            raise ValueError(f"{path}: damaged seek table")
        name, self.data, self.ids, self.count = struct.unpack(TRAILER, self._frame(count - 1))
        if name != NAME:
            raise ValueError(f"{path}: not a token file")
        self.ends = np.cumsum(self.table["plain"][:self.data], dtype=np.int64) // 4
        self.kept = (-1, np.zeros(0, np.uint32))

    def __enter__(self) -> TokenFile:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def _bytes(self, at: int, size: int) -> bytes:
        return self.file.read_at(size, at)

    def _frame(self, k: int) -> bytes:
        packed = self._bytes(int(self.places[k]), int(self.table["packed"][k]))
        size = int(self.table["plain"][k])
        try:
            plain = self.unpacker.decompress(packed, max_output_size=size)
        except zstandard.ZstdError as wrong:
            raise ValueError(f"{self.path}: damaged frame {k}") from wrong
        if len(plain) != size or _check(plain) != self.table["check"][k]:
            raise ValueError(f"{self.path}: damaged frame {k}")
        self.frames_read += 1
        return plain

    def _ids_of(self, k: int) -> np.ndarray:
        if self.kept[0] != k:
            self.kept = (k, np.frombuffer(self._frame(k), "<u4"))
        return self.kept[1]

    def read(self, at: int, size: int) -> list[np.ndarray]:
        """The ids from place ``at`` of the file, in the parts that its frames hold."""
        parts, k = [], int(np.searchsorted(self.ends, at, "right"))
        while size > 0:
            ids, start = self._ids_of(k), int(self.ends[k - 1]) if k else 0
            parts.append(ids[at - start:at - start + size])
            at, size, k = at + len(parts[-1]), size - len(parts[-1]), k + 1
        return parts

    def directory(self):
        """(ids with None for null, places, sizes) of the documents, one directory frame at a time."""
        at = 0
        for k in range(self.data, len(self.table) - 1):
            rows = np.frombuffer(self._frame(k), DOCUMENT)
            sizes = rows["size"].astype(np.int64)
            keys = pa.array(rows["id"], pa.int64(), mask=rows["null"].astype(bool)).to_pylist()
            yield keys, at + np.cumsum(sizes) - sizes, sizes
            at += int(sizes.sum())


def write_token_files(
    docs: DataFrame, tokenizer: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = 0, frame_ids: int = FRAME_IDS, file_ids: int = FILE_IDS,
) -> DataFrame:
    """Write the ids of all texts in ascending id order; the manifest comes back, one row per file.

    A document's ids are those of the tokenizer file at ``tokenizer`` followed by ``end_id``, so null and
    empty texts have one id. ``id_col`` is a whole number; null ids come first, and rows of one id follow
    each other in an order set by their texts. All rows are written, repeated ones too; other columns are
    ignored; an empty table gives an empty manifest. A file ends after the document that takes it beyond
    ``file_ids`` ids; a task writes some ``TASK_BYTES`` of text, which repays the start of its encoder. ``path`` is a folder that driver
    and executors share and that pyarrow can reach (default: a new one in the shared folder).

    Manifest: path, part and seq (their order is that of the documents), n_ids, n_docs, and base, the
    number of ids in all files before.
    """
    with open(tokenizer, encoding="utf-8") as file:
        model = file.read()
    root = (path or shared_path(docs.sparkSession, "tokens")).rstrip("/")

    def run(batches):
        encoder, task = ByteEncoder(model), TaskContext.get()
        part, seq, writer = task.partitionId(), 0, None

        def finished():
            nonlocal seq, writer
            writer.close()
            row = (writer.path, part, seq, writer.ids, len(writer.documents))
            seq, writer = seq + 1, None
            names = ["path", "part", "seq", "n_ids", "n_docs"]
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names)

        for batch in batches:
            for piece in steps(batch, "text"):
                ids, counts = encoder.encode(piece.column("text"))
                at = 0
                for key, count in zip(piece.column("id").to_pylist(), counts.tolist()):
                    if writer is None:
                        name = f"{root}/part-{part:06d}-{seq:05d}-{task.taskAttemptId()}.tokens.zst"
                        writer = TokenWriter(name, frame_ids)
                    writer.add(key, np.append(ids[at:at + count], np.int32(end_id)))
                    at += count
                    if writer.ids >= file_ids:
                        yield finished()
        if writer is not None:
            yield finished()

    text = F.col(text_col)
    keys = ["id", "mark", "place"]  # rows of one id may be dealt to several tasks
    size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("mark"),
                    F.monotonically_increasing_id().alias("place"), text.alias("text"))
        .repartitionByRange(-(-max(size, 1) // TASK_BYTES), *keys).sortWithinPartitions(*keys).select("id", "text")
    )
    kind = "path string, part long, seq long, n_ids long, n_docs long"
    files = saved(ordered.mapInArrow(tidied(run), kind), "token-files")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return saved(files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), "token-manifest")


def _dealt(manifest: DataFrame) -> DataFrame:
    """The files of a manifest, about one a task."""
    return manifest.repartitionByRange(max(manifest.count(), 1), "part", "seq")


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, and its ids if asked for.

    start counts the ids of all documents before it, n_tokens its ids with the end id; ids_crc32 is
    the crc32 of its ids as little-endian unsigned 32-bit numbers. Files are read frame by frame and every
    frame is checked.
    """

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                with TokenFile(path) as file:
                    for keys, places, sizes in file.directory():
                        for lo in range(0, len(keys), ROWS):
                            cut = slice(lo, lo + ROWS)
                            yield from _documents(file, keys[cut], places[cut], sizes[cut], base, with_ids)

    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return _dealt(manifest).select("path", "base").mapInArrow(run, kind)


def _documents(file: TokenFile, keys: list, places: np.ndarray, sizes: np.ndarray, base: int, with_ids: bool):
    """Rows of some documents of one file; batches end at about a megabyte of ids where ids are asked for."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
    marks, found, first = [], [], 0
    for k, (at, size) in enumerate(zip(places.tolist(), sizes.tolist()), 1):
        parts, mark = file.read(at, size), 0
        for part in parts:
            mark = zlib.crc32(part.tobytes(), mark)
        marks.append(mark)
        if with_ids:
            found += parts
        if k == len(keys) or (with_ids and sizes[first:k].sum() > FRAME_IDS * 4):
            columns = [
                pa.array(keys[first:k], pa.int64()), pa.array(base + places[first:k], pa.int64()),
                pa.array(sizes[first:k], pa.int64()), pa.array(marks, pa.int64()),
            ]
            if with_ids:
                flat = np.concatenate(found) if found else np.zeros(0, np.uint32)
                columns.append(lists(flat.astype(np.int64), sizes[first:k], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names[:len(columns)])
            marks, found, first = [], [], k


def document_index(manifest: DataFrame) -> DataFrame:
    """(doc_id, path, at, n_tokens, base): where each document lies, from the directories of the files."""

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                with TokenFile(path) as file:
                    for keys, places, sizes in file.directory():
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys, pa.int64()), pa.array([path] * len(keys)), pa.array(places),
                             pa.array(sizes), pa.array([base] * len(keys), pa.int64())],
                            ["doc_id", "path", "at", "n_tokens", "base"],
                        )

    kind = "doc_id long, path string, at long, n_tokens long, base long"
    return _dealt(manifest).select("path", "base").mapInArrow(run, kind)


def fetch_tokens(index: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of the wanted ids; only the frames that hold them are read.

    Each wanted id counts once; null and unknown ids give no row; an id of several documents gives each.
    """
    asked = wanted.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    places = index.join(asked, "doc_id").repartitionByRange("path", "at").sortWithinPartitions("path", "at")

    def run(batches):
        file = None
        for batch in batches:
            for row in batch.to_pylist():
                if file is None or file.path != row["path"]:
                    if file is not None:
                        file.file.close()
                    file = TokenFile(row["path"])
                place, size = np.array([row["at"]]), np.array([row["n_tokens"]])
                yield from _documents(file, [row["doc_id"]], place, size, row["base"], True)
        if file is not None:
            file.file.close()

    kind = "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>"
    return places.mapInArrow(run, kind)
