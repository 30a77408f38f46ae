"""WARC archives: whole-file gzip streams, their normaliser, sidecar offset indexes and readers.

Spark's text sink writes every file, so archives land on whatever filesystem the path names. First each
partition is one gzip stream of records. The normaliser inflates such a stream once, in slices, and
rewrites every record as its own gzip member; beside each archive it writes an index of offsets, which is
itself gzip of JSON lines. Between two members stands an empty member, which readers skip: it is the
line separator of the sink.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.llm.common import bounded_broadcast, saved, shared_path

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF2 = b"\r\n\r\n"
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
SLICE = 1 << 18
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of 40 hex digits: every five hex digits are four signs."""
    signs = []
    for part in range(8):
        value = F.conv(F.substring(hex_digest, 5 * part + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            signs.append(F.substring(F.lit(ALPHABET), F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*signs)


def page_records(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0,
) -> DataFrame:
    """(id, url, body, digest, payload_bytes, refers_to): refers_to is set for revisits.

    Among payloads of at least ``least`` bytes that are equal, the row with the largest id is the
    response; a null html is an empty payload; rows that repeat that id are responses too. A row with a
    null id revisits the others' response, or is a response if there is none.
    """
    body = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), body.alias("body"),
        F.sha1(body.cast("binary")).alias("sha1"), F.octet_length(body).cast("long").alias("payload_bytes"),
    )
    shared = saved(
        rows.where(F.col("payload_bytes") >= least).groupBy("sha1", "payload_bytes")
        .agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "payloads",
    )
    return (
        rows.join(bounded_broadcast(shared, shared.count()), ["sha1", "payload_bytes"], "left")
        .select("id", "url", "body", base32(F.col("sha1")).alias("digest"), "payload_bytes",
                F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    )


def record_text(date: str) -> Column:
    """The record of a row of ``page_records``, without the two line ends that close it."""
    urn = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">"))
    url = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\x00-\x20\x7F]", "%20")
    revisit = F.col("refers_to").isNotNull()
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"),
    )
    size = F.octet_length(head) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), urn, F.lit("\r\nWARC-Target-URI: "), url,
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(
            F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:"),
            F.col("refers_to").cast("string"), F.lit(">"),
        )).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        size.cast("string"), F.lit("\r\n\r\n"), head, F.when(revisit, "").otherwise(F.col("body")),
    )


def write_streams(records: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """One gzip stream per partition."""
    (
        records.select(record_text(date).alias("value")).write
        .option("compression", "gzip").option("lineSep", "\r\n\r\n").text(path)
    )


def inflated(content: bytes) -> Iterator[bytes]:
    """Slices of a gzip stream of one or more members, inflated once from start to end."""
    view, at, unzip = memoryview(content), 0, zlib.decompressobj(31)
    while at < len(view):
        piece = view[at:at + SLICE]
        data = unzip.decompress(piece)
        at += len(piece) - len(unzip.unused_data)
        if data:
            yield data
        if unzip.eof:
            unzip = zlib.decompressobj(31)


def header_of(head: bytes) -> dict[str, str]:
    """Lower-case field names to values; the first line is under the empty name."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {"": lines[0]}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


def stream_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and full bytes (with the closing line ends) of each record of a stream."""
    held = bytearray()
    need, fields = 0, None
    for piece in inflated(content):
        held += piece
        at = 0
        while True:
            if fields is None:
                end = held.find(CRLF2, at)
                if end < 0:
                    break
                fields = header_of(bytes(held[at:end]))
                need = end + 4 + int(fields["content-length"]) + 4 - at
            if len(held) - at < need:
                break
            yield fields, bytes(held[at:at + need])
            at, fields = at + need, None
        if at:
            del held[:at]
    if held:
        raise ValueError("the stream ends inside a record")


def normalise(spark: SparkSession, streams: str, path: str, level: int = 6) -> None:
    """Rewrite whole-file streams as archives of one member per record, each with its index.

    Archives go to ``path``/kind=archive, indexes of the same file names to ``path``/kind=index.
    """

    def run(batches):
        offset = number = 0
        for batch in batches:
            if not number:  # an archive begins with an empty member, so there is one without records too
                yield rows("archive", 0, [b""])
                yield rows("index", 0, [b""])
                offset, number = len(EMPTY_MEMBER), 1
            for content in batch.column("content"):
                lines, group, size = [], [], 0
                for fields, record in stream_records(content.as_py()):
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = packer.compress(record) + packer.flush()
                    lines.append(json.dumps({
                        "id": fields["warc-record-id"], "type": fields["warc-type"],
                        "offset": offset, "length": len(member),
                    }))
                    offset += len(member) + len(EMPTY_MEMBER)
                    group.append(member)
                    size += len(member)
                    if size > 1 << 22:
                        yield rows("archive", number, group)
                        number, group, size = number + len(group), [], 0
                if group:
                    yield rows("archive", number, group)
                    number += len(group)
                if lines:
                    yield rows("index", number, [gzip.compress(("\n".join(lines) + "\n").encode(), mtime=0)])
                    number += 1

    def rows(kind: str, number: int, values: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([kind] * len(values)), pa.array(range(number, number + len(values)), pa.int64()),
             pa.array(values, pa.binary())], ["kind", "number", "value"],
        )

    source = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(streams)
    (
        source.select("content").mapInArrow(run, "kind string, number long, value binary")
        .sortWithinPartitions("kind", "number").select("kind", F.col("value").cast("string").alias("value"))
        .write.partitionBy("kind").option("encoding", "ISO-8859-1")
        .option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)
    )


def _files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/kind={kind}")
        .select(name.alias("archive"), "content")
    )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(archive, id, type, offset, length) of every record."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("archive").to_pylist(), batch.column("content")):
                text = b"".join(inflated(content.as_py())).decode()
                entries = [json.loads(line) for line in text.splitlines()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(entries)), *[
                        pa.array([e[k] for e in entries], t) for k, t in
                        (("id", pa.string()), ("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()))
                    ]], ["archive", "id", "type", "offset", "length"],
                )

    return _files(spark, path, "index").mapInArrow(
        run, "archive string, id string, type string, offset long, length long"
    )


def parse_record(record: bytes) -> tuple:
    """id, payload bytes, payload digest, type and refers_to of a record."""
    head, _, block = record.partition(CRLF2)
    fields = header_of(head)
    http, _, payload = block[:-4].partition(CRLF2)
    kind = fields["warc-type"]
    if kind == "revisit":
        size, digest = int(header_of(http)["content-length"]), fields["warc-payload-digest"].partition(":")[2]
    else:
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    refers = fields.get("warc-refers-to")
    return urn_id(fields["warc-record-id"]), size, digest, kind, urn_id(refers) if refers else None


def urn_id(urn: str) -> int | None:
    number = urn.strip("<>").rpartition(":")[2]
    return int(number) if number else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to, archive, offset) of every record.

    The size and digest of a response are those of the payload as read; of a revisit, those it states.
    """
    schema = (
        "id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
        "archive string, offset long"
    )
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset"]

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("archive").to_pylist(), batch.column("content")):
                out = [
                    (*parse_record(record), name, offset)
                    for offset, record in members(content.as_py()) if record
                ]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), types)], names
                    )

    return _files(spark, path, "archive").mapInArrow(run, schema)


def members(content: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and inflated bytes of each gzip member."""
    view, at = memoryview(content), 0
    while at < len(view):
        start, unzip, parts = at, zlib.decompressobj(31), []
        while not unzip.eof:
            piece = view[at:at + (1 << 14)]
            if not len(piece):
                raise ValueError("the archive ends inside a member")
            parts.append(unzip.decompress(piece))
            at += len(piece) - len(unzip.unused_data)
        yield start, b"".join(parts)


def fetch_records(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """(id, record) of the stated ids only: the index names the members, nothing else is inflated."""
    wanted = read_index(spark, path).where(F.col("id").isin([f"<urn:page:{i}>" for i in ids]))
    places = wanted.groupBy("archive").agg(F.collect_list(F.struct("offset", "length")).alias("places"))

    def run(batches):
        for batch in batches:
            for content, places in zip(batch.column("content"), batch.column("places").to_pylist()):
                view = memoryview(content.as_buffer())
                found = [zlib.decompress(view[p["offset"]:p["offset"] + p["length"]], 31) for p in places]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([parse_record(r)[0] for r in found], pa.int64()), pa.array(found, pa.binary())],
                    ["id", "record"],
                )

    return _files(spark, path, "archive").join(places, "archive").mapInArrow(run, "id long, record binary")


def archive_pages(spark: SparkSession, pages: DataFrame, path: str, **columns: str) -> None:
    """Write pages as whole-file streams under ``path``/streams and normalise them to ``path``/archives."""
    write_streams(page_records(pages, **columns), f"{path}/streams")
    normalise(spark, f"{path}/streams", f"{path}/archives")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the pages, read every record back, and say whether its index entry points at it.

    An empty table gives no rows.
    """
    path = shared_path(spark, "warc")
    archive_pages(spark, pages, path)
    index = read_index(spark, f"{path}/archives").select(
        "archive", "offset", "length", F.lit(True).alias("indexed")
    )
    return (
        read_archives(spark, f"{path}/archives").join(index, ["archive", "offset"], "left")
        .select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to",
                "archive", "offset", "length", F.coalesce("indexed", F.lit(False)).alias("indexed"))
    )
