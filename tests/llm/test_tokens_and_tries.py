"""Token files, the conversation trie and tokenizer alignment against plain versions of themselves."""

import functools
import hashlib
import io
import os
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quotelake.llm import trie
from quotelake.llm.align import align_groups, alignment_counts
from quotelake.llm.packing import ByteEncoder
from quotelake.llm.queries import ORACLE, op11_token_files, op12_prefix_trie, op13_tokenizer_alignment
from quotelake.llm.tokenfile import TokenFile, document_index, fetch_tokens, read_token_files, write_token_files
from quotelake.llm.trie import conversation_trie, ordered_turns, rebuilt_turns

SF = "/root/testdata/sf0.001"
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "   ", "\n", "a", " a", "a ", "word", "Word word", "über die Straße", "日本語の文", "🎉🎉 party 👩‍👩‍👧",
    "<|endoftext|>", "x<|endoftext|>y", "<s> </s> <unk> <0x41>", "▁", "a▁b", "ends with\n\n\n", "tab\tand nbsp　wide",
    "nul\x00byte", "​﻿", "é combining", "1234567890 3.14", "don't we'll I've", "a" * 3000, "ab" * 1500,
    "\n" * 700 + "x", " \n" * 600, "the the the " * 200,
]


def digest_of(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# --- token files -----------------------------------------------------------------------------------

@functools.cache
def library():
    return Tokenizer.from_file(BYTES)


def library_ids(text):
    return library().encode(text or "", add_special_tokens=False).ids + [0]


def token_rows(spark, docs):
    """Clashing names: the operator uses id, mark, place, part and path itself."""
    rows = [(key, text, 1, "m", 2, 3, "p") for key, text in docs]
    kind = "doc_id long, text string, id int, mark string, place int, part int, path string"
    return spark.createDataFrame(rows, kind)


@pytest.fixture(scope="module")
def token_docs():
    rng = random.Random(5)
    docs = [(i * 7 % 31, t) for i, t in enumerate(ODD)]
    docs += [(None, "no id"), (None, None), (40, "again"), (40, "again"), (40, "other"), (-5, "below")]
    docs += [(100 + i, " ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(60)))) for i in range(80)]
    return docs + [(99, "long " * 40_000)]


@pytest.fixture(scope="module")
def manifest(spark, token_docs):
    files = write_token_files(token_rows(spark, token_docs).repartition(7), BYTES, frame_ids=64, file_ids=400)
    return files.cache()


def test_token_files_give_back_what_the_library_encodes(spark, token_docs, manifest):
    got = read_token_files(manifest, with_ids=True).orderBy("start").collect()
    keys = [r["doc_id"] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    want = Counter((k, tuple(library_ids(t))) for k, t in token_docs)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    at = 0
    for r in got:
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(r["ids"]), digest_of(r["ids"]))
        at += r["n_tokens"]
    assert manifest.count() > 4


def test_a_token_file_is_a_zstandard_stream_with_a_seek_table(manifest):
    for row in manifest.collect():
        with open(row["path"], "rb") as file:
            packed = file.read()
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(packed), read_across_frames=True).read()
        with TokenFile(row["path"]) as file:
            sizes = file.table["plain"].astype(int)
            assert sizes.sum() == len(plain) and file.ids == row["n_ids"] and file.count == row["n_docs"]
            ids = np.concatenate(file.read(0, file.ids))
        assert ids.tobytes() == plain[:4 * row["n_ids"]]


def test_readers_decompress_only_what_is_asked_for(spark, manifest):
    row = max(manifest.collect(), key=lambda r: r["n_docs"])
    with TokenFile(row["path"]) as file:
        places = [(at, n) for _, p, s in file.directory() for at, n in zip(p.tolist(), s.tolist())]
        before = file.frames_read
        file.read(*places[-1])
        assert file.data > 2 and file.frames_read - before <= 1 + places[-1][1] // 64
    index = document_index(manifest)
    wanted = spark.createDataFrame([(40,), (99,), (99,), (None,), (12345,), (-5,)], "doc_id long")
    got = fetch_tokens(index, wanted).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == sorted(
        (k, len(library_ids(t))) for k, t in [(40, "again"), (40, "again"), (40, "other"), (-5, "below"), (99, "long " * 40_000)]
    )
    whole = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in read_token_files(manifest).collect()}
    assert all(whole[r["doc_id"], r["start"]] == r["ids_crc32"] == digest_of(r["ids"]) for r in got)


def test_a_damaged_frame_is_reported(tmp_path, manifest):
    path = manifest.first()["path"]
    with open(path, "rb") as file:
        packed = bytearray(file.read())
    for at, message in ((6, "frame"), (len(packed) - 1, "seek table"), (len(packed) - 20, "frame|table")):
        broken = bytearray(packed)
        broken[at] ^= 0x55
        (tmp_path / f"{at}.zst").write_bytes(broken)
        with pytest.raises(ValueError, match=message):
            with TokenFile(str(tmp_path / f"{at}.zst")) as file:
                file.read(0, file.ids)


def test_an_empty_table_gives_no_files(spark):
    files = write_token_files(token_rows(spark, []), BYTES)
    assert files.count() == 0 and read_token_files(files).count() == 0 and document_index(files).count() == 0


def test_op11_equals_the_library(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()
    want, at = [], 0
    for key, text in docs:
        ids = library_ids(text)
        want.append((key, at, len(ids), digest_of(ids)))
        at += len(ids)
    assert sorted(map(tuple, op11_token_files(spark, SF).collect())) == want


def test_long_runs_of_blanks_are_encoded():
    with open(BYTES, encoding="utf-8") as file:
        encoder = ByteEncoder(file.read())
    import pyarrow as pa

    texts = [" \n" * 1_000_000, "\n" * 2_000_000, "x" + " " * 600_000 + "y z", "a\n" + "\n" * 600_000 + "b c"]
    ids, counts = encoder.encode(pa.array(texts))
    want = [library_ids(t)[:-1] for t in texts]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


# --- conversation trie -------------------------------------------------------------------------------

def trie_by_force(convs):
    """{conv_id: [(role, text), ...]} to rows, by walking every prefix."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, rows = Counter(p[:-1] for p in members if p), []
    below = defaultdict(lambda: [0, 0])
    for path, cs in members.items():
        size = (len(cs) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            below[path[:d]][0] += path not in children
            below[path[:d]][1] += size
    for path, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(convs[c]) == len(path))
        rows.append((
            min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), children[path], *below[path],
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(rows, key=str)


def tries(spark, convs, **how):
    turns = [(c, k, *t) for c, ts in convs.items() for k, t in enumerate(ts, 1)]
    got = conversation_trie(
        spark.createDataFrame(turns, "conv_id long, pos long, role string, text string"),
        spark.createDataFrame([(c, "x") for c in convs], "conv_id long, depth string"), **how,
    )
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("block", [1, 4])
def test_trie_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(trie, "CHUNK_BLOCKS", 2)
    rng = random.Random(block)
    turn = lambda: (rng.choice(["user", "assistant", ""]), rng.choice(["", "a", "ü", "b" * 9, "a\x01b"]))
    convs = {-3: [], 0: [turn() for _ in range(30)], 7: []}
    for c in range(10, 70):
        start = convs[rng.choice(list(convs))]
        convs[c] = start[:rng.randrange(len(start) + 1)] + [turn() for _ in range(rng.randrange(4))]
    convs |= {c: convs[0] for c in range(100, 160)}  # a group of copies
    assert tries(spark, convs, block_turns=block) == trie_by_force(convs)


def test_trie_of_silent_and_of_no_conversations(spark):
    assert tries(spark, {}) == []
    assert tries(spark, {4: [], 3: [], 12: []}) == trie_by_force({4: [], 3: [], 12: []})


def test_turns_are_ordered_and_rebuilt(spark):
    rows = [(1, 2, "u", "b"), (1, None, None, None), (1, 2, "a", "z"), (1, 2, "a", "z"), (None, 1, "u", "x"), (2, 5, "u", "q")]
    raw = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("p"))
    turns = ordered_turns(raw.repartition(3))
    got = sorted(map(tuple, turns.collect()))
    assert got == [(1, 1, "", ""), (1, 2, "a", "z"), (1, 3, "a", "z"), (1, 4, "u", "b"), (2, 1, "u", "q")]
    convs = spark.createDataFrame([(1,), (2,), (9,)], "conv_id long")
    one = F.when(F.col("conv_id") == 2, 1).otherwise(F.col("conv_id") + 2)
    back = rebuilt_turns(convs, turns, F.lit(2), one, 8)
    assert sorted(map(tuple, back.collect())) == [
        (1, 1, "a", "z"), (1, 2, "u", "b"), (2, 1, "", ""), (2, 2, "a", "z"),
    ]


def test_one_long_conversation_is_spread(spark):
    rows = [(5, k % 3, "user", f"t{k}") for k in range(3000)]
    turns = ordered_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8))
    want = [t for _, _, _, t in sorted(rows, key=lambda r: (r[1], r[3]))]
    assert [r["text"] for r in turns.orderBy("pos").collect()] == want
    assert sorted(r["pos"] for r in turns.collect()) == list(range(1, 3001))


def test_op12_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    cursor = con.execute(ORACLE["op12_prefix_trie"])
    names = [c[0] for c in cursor.description]
    assert sorted(map(tuple, op12_prefix_trie(spark, SF).select(names).collect()), key=str) == sorted(cursor.fetchall(), key=str)


# --- tokenizer alignment ------------------------------------------------------------------------------

def alignment_by_force(texts):
    """(groups, counts) per text, from the libraries and plain loops over byte ranges."""
    left, right = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    left.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    found = []
    for text in texts:
        a = left.encode(" " + (text or ""), add_special_tokens=False).ids
        b = right.encode(text or "")
        bytes_a = [bytes(signs[c] for c in left.id_to_token(i)) for i in a]
        bytes_b = [
            bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i)
            else right.id_to_piece(i).replace("▁", " ").encode() for i in b
        ]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            found.append(([], [], [], []))
            continue
        ranges = []
        for side in (bytes_a, bytes_b):
            ends = np.cumsum([len(x) for x in side]).tolist()
            ranges.append(list(zip([0, *ends], ends)))
        cuts = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
        groups = [
            tuple(tuple(i for i, (s, e) in zip(ids, r) if s >= lo and e <= hi) for ids, r in zip((a, b), ranges))
            for lo, hi in zip([0, *cuts], cuts)
        ]
        links = [
            (i, j) for i, (s, e) in zip(a, ranges[0]) for j, (t, f) in zip(b, ranges[1]) if max(s, t) < min(e, f)
        ]
        found.append((a, b, groups, links))
    total = Counter(x for f in found for x in f[3])
    most = defaultdict(int)
    for (_, j), n in total.items():
        most[j] = max(most[j], n)
    rows = []
    for k, (a, b, groups, links) in enumerate(found):
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        rows.append((
            k, len(a), len(b), len(groups), len(links), sum(total[x] == most[x[1]] for x in links),
            sum(total[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return rows, [f[2] for f in found]


def align_texts():
    rng = random.Random(9)
    words = ["internationalisation", "Größe", "naïve", "tokenizer", "日本", "x1y2", "don't", "🎉", " ", "==>", "the"]
    return [t[:400] if t else t for t in ODD] + [
        "".join(rng.choice(words) + rng.choice([" ", "", "  ", "\n"]) for _ in range(rng.randrange(25))) for _ in range(30)
    ]


def test_alignment_equals_brute_force(spark):
    texts = align_texts()
    texts += texts[8:12]
    want, groups = alignment_by_force(texts)
    rows = [(i, t, 7, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int, pairs string, block int").repartition(5)
    assert sorted(map(tuple, alignment_counts(docs, BYTES, PIECES, block_bytes=300).collect())) == want
    assert sorted(map(tuple, alignment_counts(docs, BYTES, PIECES).collect())) == want
    got = {r["doc_id"]: [(tuple(g["a"]), tuple(g["b"])) for g in r["groups"]] for r in align_groups(docs, BYTES, PIECES).collect()}
    assert got == dict(enumerate(groups))


def test_alignment_of_odd_tables(spark):
    kind = "doc_id long, text string"
    assert alignment_counts(spark.createDataFrame([], kind), BYTES, PIECES).count() == 0
    rows = [(None, "a b"), (None, None), (3, "a b"), (3, "a b"), (4, None)]
    got = sorted(map(str, alignment_counts(spark.createDataFrame(rows, kind), BYTES, PIECES).collect()))
    assert len(got) == 5 and got[0].split(", n_a")[1] == got[1].split(", n_a")[1]
    nothing = alignment_counts(spark.createDataFrame([(1, None), (2, "")], kind), BYTES, PIECES).collect()
    assert sorted(map(tuple, nothing)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_alignment_of_a_very_long_text(spark):
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(50)}" for _ in range(60_000)) + " \n" * 200_000 + "a" * 20_000
    row = alignment_counts(spark.createDataFrame([(1, text)], "doc_id long, text string"), BYTES, PIECES).first()
    assert row["n_links"] == row["n_a"] + row["n_b"] - row["n_groups"] > 0


def test_op13_equals_brute_force(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()
    short = [t for _, t in docs if t is None or len(t) < 1500]
    got = alignment_counts(spark.createDataFrame(list(enumerate(short)), "doc_id long, text string"), BYTES, PIECES)
    assert sorted(map(tuple, got.collect())) == alignment_by_force(short)[0]
    assert op13_tokenizer_alignment(spark, SF).where("n_links = n_a + n_b - n_groups").count() == len(docs)


def test_executors_need_no_local_files(manifest):
    assert all(os.path.exists(r["path"]) for r in manifest.collect())
