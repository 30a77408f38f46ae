"""Chunked operators equal a plain Python fold, whatever the chunk width."""

import random

import pytest
from pyspark.sql import functions as F

from quotelake.operators import activation, live, ordered, sentences, synthetic, training
from quotelake.operators.ordered import Axis


def _rows(n=300, seed=1):
    rng = random.Random(seed)
    # one stream holds most of the rows; order values have gaps
    rows, seq = [], 0
    for _ in range(n):
        seq += rng.choice([1, 1, 2, 9])
        rows.append(("hot" if rng.random() < 0.7 else f"s{rng.randrange(4)}", seq, rng.randrange(-2, 5)))
    return rows


@pytest.mark.parametrize("width", [1, 7, 100000])
def test_running_sum_and_carry(spark, width):
    rows = _rows()
    df = spark.createDataFrame(rows, "k string, seq long, v long")
    axis = Axis(("k",), ("seq",), width)
    got = ordered.carry_last(
        ordered.running_sum(df, axis, F.col("v"), "before"), axis,
        {"last_big": F.when(F.col("v") > 2, F.col("v"))},
    )
    sums, last, want = {}, {}, {}
    for k, s, v in rows:
        want[(k, s)] = (sums.get(k, 0), last.get(k))
        sums[k] = sums.get(k, 0) + v
        if v > 2:
            last[k] = v
    assert {(r["k"], r["seq"]): (r["before"], r["last_big"]) for r in got.collect()} == want


def _words(rng, n):
    return [rng.choice("a b c d. e! f".split()) for _ in range(n)]


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_segment_windows(spark, width):
    rng = random.Random(3)
    rows = [(rng.choice(["x", "x", "y"]), i * 2, " ".join(_words(rng, rng.randrange(0, 5)))) for i in range(80)]
    df = spark.createDataFrame(rows, "stream_id string, seg_id long, text string")
    got = {
        (r["stream_id"], r["sent_id"]): (r["candidate_text"], r["prev_text"], r["next_text"])
        for r in sentences.segment_windows(df, width=width).collect()
    }
    import re

    want = {}
    for stream in "xy":
        sents = [p for k, _, t in rows if k == stream for p in re.split(r"(?<=[.!?])\s+", t) if p.strip()]
        for i, s in enumerate(sents):
            ahead = " ".join(sents[i + 1:]).split()[:12]
            want[(stream, i)] = (s, sents[i - 1] if i else "", " ".join(ahead))
    assert got == want
    one = sentences.segment_sentences(df, width=width)
    assert {(r["stream_id"], r["sent_id"]): r["candidate_text"] for r in one.collect()} == {k: v[0] for k, v in want.items()}


@pytest.mark.parametrize("width", [2, 50, 100000])
def test_overlap_trim_exact(spark, width):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.8 else "b", i, " ".join(rng.choice("ab") for _ in range(rng.randrange(1, 15)))) for i in range(150)]
    got = sentences.overlap_trim_exact(
        spark.createDataFrame(rows, "k string, seq long, text string"), "k", "seq", width=width
    )
    prev, want = {}, {}
    for k, s, text in rows:
        before, after = prev.get(k, "").split(), text.split()
        n = next((j for j in range(min(len(before), len(after), 10), 0, -1) if before[-j:] == after[:j]), 0)
        kept = " ".join(after[n:]) if n else text
        prev[k] = kept or text
        if kept:  # rows of which nothing is left are dropped
            want[(k, s)] = (n, kept)
    assert {(r["k"], r["seq"]): (r["dropped"], r["trimmed"]) for r in got.collect()} == want


@pytest.mark.parametrize("width", [3, 40, 100000])
def test_activation_outcomes(spark, width):
    rng = random.Random(9)
    actions = ["activate"] * 4 + ["heartbeat"] * 2 + ["deactivate"] * 2
    rows = [
        (i, "hot" if rng.random() < 0.7 else "k2", f"d{rng.randrange(3)}", "revoke" if i == 190 else rng.choice(actions))
        for i in range(200)
    ]
    log = spark.createDataFrame(rows, "seq long, license_key string, fingerprint string, action string")
    got = {r["seq"]: r["outcome"] for r in activation.activation_outcomes(log, width=width).collect()}
    holder, revoked, want = {}, set(), {}
    for seq, key, dev, action in rows:
        h = holder.get(key)
        if action == "revoke":
            revoked.add(key)
            want[seq] = "revoked"
        elif key in revoked:
            want[seq] = "refused"
        elif action == "activate":
            want[seq] = "activated" if h is None else "refreshed" if h == dev else "conflict"
            holder[key] = h or dev
        elif action == "heartbeat":
            want[seq] = "seen" if h == dev else "not_active"
        else:
            want[seq] = "released" if h == dev else "not_active"
            holder[key] = None if h == dev else h
    assert got == want


def test_split_is_exact_and_disjoint(spark):
    rows = [(f"text {i}", "positive" if i % 7 == 0 else "negative") for i in range(500)]
    df = training.stratified_split(spark.createDataFrame(rows, "text string, label string"))
    got = {r["label"]: (r["n"], r["v"]) for r in df.groupBy("label").agg(F.count("*").alias("n"), F.count_if("is_validation").alias("v")).collect()}
    assert got == {"positive": (72, 8), "negative": (428, 43)}
    assert df.select("text").distinct().count() == 500


def test_quota_takes_the_first_rows(spark):
    rows = [(i, "a" if i % 3 else "b", f"t{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, subtype string, text string")
    kept = synthetic.accept_quota(df, "row_id", {"a": 5, "b": 3}, width=4).collect()
    assert sorted(r["row_id"] for r in kept) == sorted([1, 2, 4, 5, 7] + [0, 3, 6])


def test_accumulate_cues_replaces_contained_text(spark):
    rows = [("s", i, t) for i, t in enumerate([
        "it is written that all", "it is written that all men", "shall see it.", "no", "paul says one two",
        "the bible says three four five", "next verse", "a new line here.",
    ])]
    df = live.accumulate_cues(spark.createDataFrame(rows, "k string, seq long, text string"), "k", "seq", width=3)
    # a repeated opener starts a new quotation
    assert [r["candidate_text"] for r in df.orderBy("quote_no").collect()] == [
        "it is written that all", "it is written that all men shall see it.", "paul says one two",
        "the bible says three four five", "a new line here.",
    ]


def test_a_key_with_many_devices_is_linear(spark):
    """65 536 devices of one key, several chunks: each chunk is tabulated in one backward pass."""
    n = 65_536
    rows = [(i, "k", f"d{i}", "activate") for i in range(n)]
    rows += [(n, "k", "d0", "deactivate"), (n + 1, "k", "d7", "activate"), (n + 2, "k", "d0", "activate")]
    log = spark.createDataFrame(rows, "seq long, license_key string, fingerprint string, action string")
    out = activation.activation_outcomes(log, width=20_000)
    assert out.groupBy("outcome").count().orderBy("outcome").collect() == [
        ("activated", 2), ("conflict", n), ("released", 1)
    ]
    assert {r["seq"] for r in out.filter("outcome = 'activated'").collect()} == {0, n + 1}


def test_quotas_count_texts_as_seen_only_when_accepted(spark):
    """Row by row: a text whose subtype was full may come in under another subtype."""
    rng = __import__("random").Random(4)
    rows = [(i, f"text {rng.randrange(30)}", rng.choice("aabbc")) for i in range(200)]
    targets = {"a": 4, "b": 6, "c": 9}
    seen, used, want = set(), dict.fromkeys(targets, 0), []
    for i, text, subtype in rows:
        if text not in seen and used[subtype] < targets[subtype]:
            seen.add(text)
            used[subtype] += 1
            want.append(i)
    df = spark.createDataFrame(rows, "row_id long, text string, subtype string")
    got = synthetic.accept_fresh(df, "row_id", targets, width=16)
    assert sorted(r["row_id"] for r in got.collect()) == want
    done, rest = df.filter("row_id < 50"), df.filter("row_id >= 50")
    first = synthetic.accept_fresh(done, "row_id", targets)
    more = synthetic.accept_fresh(rest, "row_id", targets, existing=first)  # a resumed run
    assert sorted(r["row_id"] for r in first.unionByName(more).collect()) == want


def test_short_streams_are_one_chunk_however_sparse(spark):
    rows = [("long", i) for i in range(9)] + [("short", i * 1000) for i in range(3)] + [(None, 0), (None, 50), ("short", None)]
    df = spark.createDataFrame(rows, "k string, seq long")
    cut = Axis(("k",), ("seq",), 4).cut_long(df).collect()
    assert sorted((r["k"], r["seq"], r["_chunk"]) for r in cut if r["k"] and r["seq"] is not None) == (
        [("long", i, i // 4) for i in range(9)] + [("short", i * 1000, 0) for i in range(3)]
    )
    # rows of no stream stay cut by order value, rows without one keep none
    assert {(r["seq"], r["_chunk"]) for r in cut if r["k"] is None or r["seq"] is None} == {(0, 0), (50, 12), (None, None)}


def test_the_license_report_folds_the_log_once(spark, tmp_path):
    rows = [(1, "a", "x", "activate"), (5, "a", "y", "activate"), (9, "b", "x", "activate"), (12, "b", "z", "revoke"), (15, "c", "q", "heartbeat")]
    spark.createDataFrame(rows, "seq long, license_key string, fingerprint string, action string").withColumn(
        "ts", F.timestamp_seconds("seq")).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    out = activation.license_report(activation.activation_outcomes(log))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3  # tables, entries, replay
    assert {(r["license_key"], r["n_conflicts"], r["status"], str([(d["fingerprint"], d["status"]) for d in r["devices"] or []]))
            for r in out.collect()} == {
        ("a", 1, "active", "[('x', 'active')]"), ("b", 0, "revoked", "[('x', 'deactivated')]"), ("c", 0, "unactivated", "[]")}


def test_unseen_shuffles_only_the_columns_kept(spark):
    df = spark.createDataFrame([(2, "A  b", 4), (1, "a b", 3), (3, None, None)], "id long, text string, n int")
    out = synthetic.unseen(df, None, "id", keep=["id", "n"])
    assert sorted(map(tuple, out.collect())) == [(1, 3), (3, None)]
