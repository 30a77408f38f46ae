"""Secret scans with structural confirmation.

Three base patterns are reported as they match. Beyond them, runs of base64 or hex digits, PEM bodies
and three-part tokens are decoded, and reported only if what comes out parses: private-key encodings
with nested lengths that add up to the last byte, or a token header that names its algorithm. Base64
may be of either alphabet and wrapped in lines, with line ends as such or written out as in JSON.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelake.llm.common import lists, steps, tidied

# fixed values: the base patterns
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"

BASE_KINDS = ["assign", "access", "hex"]
KINDS = [*BASE_KINDS, "pem", "key64", "keyhex", "jwt"]

# what a text needs at least for a pattern to be worth running; automata without captures
NEEDS = {
    "assign": r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}", "pem": r"PRIVATE KEY-----", "key64": r"[A-Za-z0-9+/_-]{16}",
    "keyhex": r"30[0-9A-Fa-f]{62}", "jwt": r"[CDIe][A-Za-z0-9_-]{7,}\.[CDIe][A-Za-z0-9_-]*\.[A-Za-z0-9_-]",
}
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:[^-]|-(?!----))*+)-----END \1-----")
SEAM = re.compile(r"[\x20\t]*(?:\r?\n|(?:\\r)?\\n)[\x20\t]*")
LEAST_SIGNS = 40
RUNHEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
# a JSON object starts with a brace or a blank, so its base64 with one of four letters
TOKEN = re.compile(
    r"(?<![A-Za-z0-9_-])(?=([CDIe][A-Za-z0-9_-]{7,})\.([CDIe][A-Za-z0-9_-]*)\.([A-Za-z0-9_-]+))"
)
FOUND = "spans array<struct<kind:string,start:long,end:long>>"


def der_item(data: bytes, at: int, stop: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the item at ``at``, or None if its length does not fit."""
    if at + 2 > stop:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size >= 0x80:
        count = size & 0x7F
        if not 1 <= count <= 4 or at + count > stop:
            return None
        size = int.from_bytes(data[at:at + count], "big")
        at += count
    return (tag, at, at + size) if at + size <= stop else None


def der_items(data: bytes, at: int, stop: int) -> list[tuple[int, int, int]] | None:
    """All items of a range that they fill exactly."""
    out = []
    while at < stop:
        item = der_item(data, at, stop)
        if item is None:
            return None
        out.append(item)
        at = item[2]
    return out


def is_private_key(data: bytes) -> bool:
    """A complete PKCS#8, PKCS#1, SEC1 or DSA key, or the OpenSSH format."""
    if data.startswith(b"openssh-key-v1\0"):
        at, read = 15, 0
        while read < 3:  # cipher, derivation, its options
            size = int.from_bytes(data[at:at + 4], "big")
            if at + 4 + size > len(data):
                return False
            at, read = at + 4 + size, read + 1
        return int.from_bytes(data[at:at + 4], "big") >= 1
    outer = der_item(data, 0, len(data))
    if outer is None or outer[0] != 0x30 or outer[2] != len(data):
        return False
    items = der_items(data, outer[1], outer[2])
    if not items or items[0][0] != 0x02:
        return False
    tags = [t for t, _, _ in items]
    version = data[items[0][1]:items[0][2]]
    if tags[1:3] == [0x30, 0x04] and version in (b"\0", b"\1"):
        inner = der_items(data, items[1][1], items[1][2])
        return bool(inner) and inner[0][0] == 0x06
    if tags[1:2] == [0x04] and version == b"\1":
        return True
    return set(tags) == {0x02} and len(tags) in (6, 9) and version == b"\0"


def is_encrypted_key(data: bytes) -> bool:
    """A complete encrypted PKCS#8 key: the algorithm with its identifier, then one octet string."""
    outer = der_item(data, 0, len(data))
    if outer is None or outer[0] != 0x30 or outer[2] != len(data):
        return False
    items = der_items(data, outer[1], outer[2])
    if not items or [t for t, _, _ in items] != [0x30, 0x04]:
        return False
    inner = der_items(data, items[0][1], items[0][2])
    return bool(inner) and inner[0][0] == 0x06


def _decoded(text: str, urlsafe: bool = False) -> bytes | None:
    text = text.rstrip("=")
    try:
        return base64.b64decode(
            text + "=" * (-len(text) % 4), altchars=b"-_" if urlsafe else None, validate=True
        )
    except (binascii.Error, ValueError):
        return None


def is_signed_token(header: str, claims: str) -> bool:
    """The header is a JSON object that names an algorithm, the claims are a JSON object."""
    parts = []
    for part in (header, claims):
        try:
            parts.append(json.loads(_decoded(part, urlsafe=True) or b""))
        except (ValueError, RecursionError):
            return False
    return all(isinstance(p, dict) for p in parts) and isinstance(parts[0].get("alg"), str)


def confirmed_pem(body: str) -> bool:
    """What stands between the marks of a PEM block is a private key, plain or encrypted."""
    lines = [line.strip() for line in body.replace("\\r", "\n").replace("\\n", "\n").replace("\\/", "/").split("\n")]
    headers = [line for line in lines if ":" in line]
    data = _decoded("".join("".join(line.split()) for line in lines if ":" not in line))
    if not data:
        return False
    if any(h.startswith("Proc-Type:") and h.endswith("ENCRYPTED") for h in headers):
        return any(h.startswith("DEK-Info:") for h in headers)
    return is_private_key(data) or is_encrypted_key(data)


def openssh_end(data: bytes) -> int | None:
    """Where an OpenSSH key ends: three strings, a count, so many public keys and the private part."""
    at, left, count = 15, 3, None
    while left:
        size = int.from_bytes(data[at:at + 4], "big")
        at, left = at + 4 + size, left - 1
        if at > len(data):
            return None
        if not left and count is None:
            count = int.from_bytes(data[at:at + 4], "big")
            if not count:
                return None
            at, left = at + 4, count + 1
    return at


def key_signs(signs: str, first: int, size: int, urlsafe: bool) -> int | None:
    """How many base64 signs from ``first`` on are one key, if one starts there; its line has ``size``.

    The first bytes say what it would be, their lengths where it would end; only that much is decoded.
    """

    def part(count: int) -> bytes:
        return _decoded(signs[first:first + count], urlsafe) or b""

    def signs_for(count: int) -> int:
        return -(-count * 8 // 6)

    have = len(signs) - first
    full = have - (have % 4 == 1)
    head = part(min(24, full))
    if head[:1] == b"\x30" and len(head) > 6:
        long = head[1] - 0x80
        if long > 4:
            return None
        total = head[1] + 2 if long < 0 else int.from_bytes(head[2:2 + long], "big") + 2 + long
        need = signs_for(total)
        if not LEAST_SIGNS <= need <= have:
            return None
        data = part(need)
        return need if is_private_key(data) or is_encrypted_key(data) else None
    if head.startswith(b"openssh-key-v1\0"):
        data = part(full)
        end = openssh_end(data)
        if end is not None:
            return signs_for(end)
        return size if size >= LEAST_SIGNS and is_private_key(part(size)) else None
    if head.startswith(b"-----BEGIN "):
        data = part(full).decode("latin-1")
        found = PEM.match(data)
        if found and confirmed_pem(found[2]):
            rest = data[found.end():]
            return signs_for(found.end() + len(rest) - len(rest.lstrip()))
    return None


def key_finder(alphabet: str, urlsafe: bool):
    """A function from a text to the spans of base64 runs, over one or several lines, that are keys."""
    run = re.compile(
        rf"(?:(?<=\\[nr])|(?<![{alphabet}])(?!(?<=\\)[nrt]))[{alphabet}]{{16,}}(?:{SEAM.pattern}[{alphabet}]+)*+"
    )

    def find(text: str) -> list[tuple[int, int]]:
        out = []
        for m in run.finditer(text):
            seams = [s.span() for s in SEAM.finditer(text, *m.span())]
            starts, ends = [m.start(), *[b for _, b in seams]], [*[a for a, _ in seams], m.end()]
            sums = list(accumulate((b - a for a, b in zip(starts, ends)), initial=0))
            signs, done = "".join(text[a:b] for a, b in zip(starts, ends)), 0
            for k, first in enumerate(sums[:-1]):
                used = key_signs(signs, first, sums[k + 1] - first, urlsafe) if first >= done else None
                if used is None:
                    continue
                line = bisect_left(sums, first + used)
                if line < len(sums) and sums[line] == first + used:  # a key ends where a line of the run ends
                    done, end = first + used, ends[line - 1]
                    out.append((starts[k], end + len(text[end:end + 2]) - len(text[end:end + 2].lstrip("="))))
        return out

    return find


def signed_tokens(text: str) -> list[tuple[int, int]]:
    out = []
    for m in TOKEN.finditer(text):
        if (not out or m.start() >= out[-1][1]) and is_signed_token(m[1], m[2]):
            out.append((m.start(), m.end(3)))
    return out


def finders() -> dict:
    """By kind: a function from a text to its (start, end) pairs."""
    assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
    access, digits = re.compile(ACCESS), re.compile(HEX + r"(?<=[0-9a-f]{24})")
    plain, urlsafe = key_finder("A-Za-z0-9+/", False), key_finder("A-Za-z0-9_-", True)

    def pems(t: str) -> list[tuple[int, int]]:
        return [m.span() for m in PEM.finditer(t) if confirmed_pem(m[2])]

    def keys(t: str) -> list[tuple[int, int]]:
        blocks, out = pems(t), []
        for start, end in sorted({*plain(t), *urlsafe(t)}):
            if not any(a <= start and end <= b for a, b in [*blocks, *out[-1:]]):
                out.append((start, end))
        return out

    return {
        "assign": lambda t: [m.span() for m in assign.finditer(t) if len(m[2]) >= 6],
        "access": lambda t: [m.span() for m in access.finditer(t) if len(m[0]) >= 20],
        "hex": lambda t: [m.span() for m in digits.finditer(t)],
        "pem": pems,
        "key64": keys,
        "keyhex": lambda t: [
            m.span() for m in RUNHEX.finditer(t)
            if is_private_key(data := bytes.fromhex(m[0])) or is_encrypted_key(data)
        ],
        "jwt": signed_tokens,
    }


def spans_of(texts: pa.Array) -> list[list[tuple[int, int, str]]]:
    """Per text: (start, kind number, end) of all finds, sorted; a null is an empty text."""
    texts = pc.fill_null(texts, "")
    out: list[list[tuple]] = [[] for _ in range(len(texts))]
    for number, (kind, find) in enumerate(finders().items()):
        rows = np.flatnonzero(pc.match_substring_regex(texts, NEEDS[kind]).to_numpy(zero_copy_only=False))
        for row, text in zip(rows.tolist(), texts.take(pa.array(rows)).to_pylist()):
            out[row] += [(start, number, end) for start, end in find(text)]
    return [sorted(spans) for spans in out]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): kind, start and end (code points, end exclusive) of every find, by start, then kind.

    A null or empty text has none; null and repeated ids are passed on; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                found = spans_of(part.column("text"))
                flat = [s for spans in found for s in spans]
                values = pa.StructArray.from_arrays(
                    [pa.array([KINDS[k] for _, k, _ in flat], pa.string()),
                     pa.array([s for s, _, _ in flat], pa.int64()), pa.array([e for _, _, e in flat], pa.int64())],
                    ["kind", "start", "end"],
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), lists(values, np.array([len(s) for s in found]), values.type)],
                    ["id", "spans"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(tidied(run), f"id {kind}, {FOUND}").withColumnRenamed("id", id_col)


def span_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per base kind, digest of the base spans and the list of all spans."""

    def listed(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
        )

    base = F.filter("spans", lambda s: s["kind"].isin(BASE_KINDS))
    count = {k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long") for k in BASE_KINDS}
    return found.select(
        id_col, *[count[k].alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_confirmed"),
    )


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every found span of the text replaced; overlaps become one mark.

    Null texts stay null.
    """
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            numbered = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
            for part in steps(numbered, f"c{at}"):
                found = spans_of(part.column(at))
                if any(found):
                    fresh = part.column(at).to_pylist()
                    fresh = [_redacted(t, spans, mark) if spans else t for t, spans in zip(fresh, found)]
                    part = part.set_column(at, part.schema.field(at), pa.array(fresh, part.schema.field(at).type))
                yield part.rename_columns(names)

    return docs.mapInArrow(tidied(run), docs.schema)


def _redacted(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    out, at, covered = [], 0, -1
    for start, _, end in spans:
        if start >= covered:
            out += [text[at:start], mark]
        at = covered = max(covered, end)
    return "".join([*out, text[at:]])
