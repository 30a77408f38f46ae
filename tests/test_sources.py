import csv
import json

from pyspark.sql import functions as F

from quotelake.functions import vectors as V
from quotelake.operators import labels, sentences, triage
from quotelake.plans import datasets, detection
from quotelake.sources import corpus, ingest, tables, transcripts


def _write(path, data):
    path.write_text(data if isinstance(data, str) else json.dumps(data), encoding="utf-8")
    return str(path)


def test_edition_files_and_aliases(spark, tmp_path):
    usual = {"version": "AMPLIFIED", "books": [{"book": "Ezra", "chapters": [
        {"chapter": 1, "verses": [{"verse": 1, "text": " Alpha beta. "}, {"verse": 2, "text": "  "}]}]}]}
    other = [{"bookName": "Ezra", "chapters": [{"chapter_number": 1, "verses": [{"verse_number": 1, "verseText": "Alpha beta."}]}]}]
    a = corpus.read_edition(spark, _write(tmp_path / "a.json", usual)).collect()
    b = corpus.read_edition(spark, _write(tmp_path / "b.json", other), "amplified").collect()
    assert [tuple(r) for r in a] == [("AMP", "Ezra", 1, 1, "Alpha beta.")] == [tuple(r) for r in b]


def test_multi_edition_file(spark, tmp_path):
    data = {"versions": ["KJV", "AMPLIFIED"], "books": [{"book": "first samuel", "chapters": [
        {"chapter": 2, "verses": [{"verse": 3, "text": {"KJV": "k", "AMPLIFIED": "a", "ESV": " "}}, {"verse": 4, "text": "plain"},
                                  {"verse": 3, "text": {"KJV": "later"}}]}]}]}
    rows = corpus.read_editions(spark, _write(tmp_path / "m.json", data)).collect()
    assert sorted(tuple(r) for r in rows) == [
        ("AMP", "1 Samuel", 2, 3, "a"), ("KJV", "1 Samuel", 2, 3, "later"), ("KJV", "1 Samuel", 2, 4, "plain")]


def test_index_round_trip(spark, tmp_path):
    p = spark.createDataFrame([("AMP", "Ezra", 1, i, f"word number {i} here") for i in range(5)], "edition string, work string, section int, item int, text string")
    path = str(tmp_path / "index")
    corpus.write_index(p, path, V.BowEmbedder(32))
    index = corpus.read_index(spark, path, 5)
    queries = spark.createDataFrame([(1, "word number 3 here")], "query_id int, query string")
    found = detection.search(queries, index, k=2, embedder=V.BowEmbedder(32)).collect()
    assert len(found) == 2 and found[0]["score"] >= found[1]["score"]


def test_transcripts_words_and_errors(spark, tmp_path):
    folder = tmp_path / "t"
    folder.mkdir()
    _write(folder / "one.json", {"source_file": "one.mp3", "segments": [
        {"text": " a b ", "start": 2.0, "end": 4.0},
        {"text": "c", "start_time": 4.0, "end_time": 5.0, "words": [{"text": "c.", "start_time": 4.5, "end_time": 5.0}, {"text": " "}]}]})
    _write(folder / "bad.json", "{nope")
    files = transcripts.read_transcripts(spark, str(folder))
    assert {r["stream_id"]: r["status"] for r in files.collect()} == {"one": "ok", "bad": "error"}
    segs = transcripts.segments(files)
    words = transcripts.interpolated_words(segs).orderBy("seg_id", "pos").collect()
    assert [(r["word"], r["start_time"], r["end_time"]) for r in words] == [("a", 2.0, 3.0), ("b", 3.0, 4.0), ("c.", 4.5, 5.0)]
    arrays = transcripts.file_words(files).first()
    assert arrays["words"] == ["a", "b", "c."] and arrays["starts"] == [2.0, 3.0, 4.5]
    out = str(tmp_path / "labels")
    datasets.build_labelling_csv(spark, str(folder), out)
    assert tables.read_labelled_csv(spark, out).count() == 1


def test_greedy_lines_cover_all_words(spark):
    words = ("one two three. four five six seven eight nine ten eleven twelve thirteen fourteen fifteen now turn to "
             "romans chapter eight. and then it ends here").split()
    files = spark.createDataFrame([(1, words)], "f int, words array<string>")
    lines = labels.build_lines(labels.thin_breaks(labels.break_positions(files))).orderBy("line_no").collect()
    assert " ".join(r["text"] for r in lines) == " ".join(words)
    assert all(1 <= r["next_word"] - r["first_word"] <= 14 for r in lines)
    assert any(r["matched_trigger"] for r in lines)


def test_line_ends_equal_a_plain_walk(spark):
    import random

    rng = random.Random(4)
    rows = []
    for f in range(25):
        n = rng.randrange(0, 120)
        words = ["w." if rng.random() < 0.12 else "w" for _ in range(n)]
        at = sorted(rng.sample(range(n), min(n, rng.randrange(0, 8)))) if n else []
        rows.append((f, words, [(a, f"t{a}") for a in at]))
    files = spark.createDataFrame(rows, "f int, words array<string>, breaks array<struct<at:int,phrase:string>>")
    thin = {r["f"]: [b["at"] for b in r["breaks"]] for r in labels.thin_breaks(files).collect()}
    got = {}
    for r in labels.build_lines(labels.thin_breaks(files)).orderBy("f", "line_no").collect():
        got.setdefault(r["f"], []).append((r["first_word"], r["next_word"], r["matched_trigger"]))
    for f, words, breaks in rows:
        kept = []
        for a, _ in breaks:
            if not kept or a - kept[-1] >= 5:
                kept.append(a)
        assert thin[f] == kept
        cursor, want = 0, []
        while cursor < len(words):
            ahead = [a for a in kept if a > cursor]
            if ahead and ahead[0] - cursor <= 14:
                end = ahead[0]
            else:
                stops = [j + 1 for j in range(cursor + 4, min(cursor + 14, len(words))) if words[j].endswith(".")]
                end = stops[0] if stops else min(cursor + 9, len(words))
            want.append((cursor, end, f"t{cursor}" if cursor in kept else ""))
            cursor = end
        assert got.get(f, []) == want


def test_ragged_csv(spark, tmp_path):
    path = _write(tmp_path / "r.csv", "text,verse,,\nplain,,,positive\nwith, a comma,John 1:1,,negative\n\"quoted, one\",,,\nshort\n,,,\n")
    rows = tables.read_ragged_csv(spark, path).orderBy("line").collect()
    assert [(r["line"], r["text"], r["verse"], r["label"]) for r in rows] == [
        (2, "plain", "", "positive"), (3, "with, a comma", "John 1:1", "negative"), (4, "quoted, one", "", ""),
        (5, "short", "", ""), (6, "", "", "")]
    gold, todo, blank = triage.split_rows(tables.read_ragged_csv(spark, path))
    assert (gold.count(), todo.count(), blank.count()) == (2, 2, 1)
    p = spark.createDataFrame([(1, "AMP", "Ezra", 1, 1, "short plain words"), (2, "NKJV", "Ezra", 1, 1, "short plain words")],
                              "passage_id long, edition string, work string, section int, item int, text string")
    out = detection.triage_rows(tables.read_ragged_csv(spark, path), p)
    sheet = triage.review_sheet(gold, out.filter("label = ''"))
    assert sheet.columns == triage.OUT_COLUMNS and sheet.count() == 4


def test_json_lines_and_split_sinks(spark, tmp_path):
    df = spark.createDataFrame([("t1", "a"), ("t2", "b")], "text string, label string")
    path = str(tmp_path / "rows")
    tables.append_json_lines(df, path)
    tables.append_json_lines(df, path)
    assert tables.read_json_lines(spark, path, "text string, label string").count() == 4
    tables.export_csv(spark, path, str(tmp_path / "csv"), "text string, label string", ["label"])
    assert tables.read_first_column(spark, str(tmp_path / "csv")).count() >= 4
    tables.write_split(df.withColumn("is_validation", F.col("label") == "a"), str(tmp_path / "split"))
    assert tables.read_labelled_csv(spark, str(tmp_path / "split/validation")).count() == 1


def test_pending_files(spark):
    listing = spark.createDataFrame([("a (1).mp3",), ("b.mp3",)], "name string")
    done = spark.createDataFrame([("a__1_",)], "safe_id string")
    assert [r["name"] for r in transcripts.pending(listing, done).collect()] == ["b.mp3"]


def test_empty_result_writes(spark, tmp_path):
    p = spark.createDataFrame([(1, "AMP", "Ezra", 1, 1, "alpha beta gamma")], "passage_id long, edition string, work string, section int, item int, text string")
    segs = spark.createDataFrame([("s", 0, "nothing like it here.", 0.0, 1.0)], "stream_id string, seg_id long, text string, start_time double, end_time double")
    records = detection.detect_segments(segs, p)
    tables.write_records(records, str(tmp_path / "out"))
    assert spark.read.schema(records.schema).json(str(tmp_path / "out")).count() == 0


def test_detection_finds_the_quoted_passage(spark):
    rows = [("AMP", 1, "Let brotherly love continue among you always."), ("NKJV", 1, "Let brotherly love continue among you always"),
            ("AMP", 2, "The quick brown fox jumps over lazy dogs.")]
    p = spark.createDataFrame([(i, e, "Hebrews", 13, it, t) for i, (e, it, t) in enumerate(rows)], "passage_id long, edition string, work string, section int, item int, text string")
    segs = spark.createDataFrame([("s", 0, "Good morning. The Bible says let brotherly love continue among you always. The market closed higher.", 0.0, 9.0)],
                                 "stream_id string, seg_id long, text string, start_time double, end_time double")
    for kind in ("semantic", "rules"):
        got = detection.detect_segments(segs, p, detector=kind).collect()
        assert [r["selected_reference"] for r in got] == ["Hebrews 13:1"]
        assert got[0]["edition"] == "AMP" and len(got[0]["candidates"]) == 3
    assert sentences.segment_windows(segs).count() == 3


def test_ingest_ledger_over_runs_and_retries(spark, tmp_path):
    home = {k: str(tmp_path / k) for k in ("in", "out", "ledger", "check")}
    (tmp_path / "in").mkdir()

    def transcript(name, *texts):
        segs = [{"text": t, "start_time": i, "end_time": i + 1} for i, t in enumerate(texts)]
        _write(tmp_path / "in" / name, {"source_file": name, "segments": segs})

    def run():
        ingest.ingest_files(spark, home["in"], home["out"], home["ledger"], home["check"]).awaitTermination()
        rows = ingest.ledger_rows(spark, home["ledger"]).collect()
        return sorted((r["name"], r["safe_id"], r["status"], r["error"], r["n_segments"], r["attempt"]) for r in rows)

    transcript("one (a).json", "first.", "second.")
    transcript("none.json")
    _write(tmp_path / "in" / "broken.json", '{"segments": [')
    _write(tmp_path / "in" / "other.json", '{"lines": []}')
    broken, none = ("broken.json", "broken", "error", "not JSON", None, 0), ("none.json", "none", "ok", None, 0, 0)
    one, other = ("one (a).json", "one__a_", "ok", None, 2, 0), ("other.json", "other", "error", "no segments", None, 0)
    assert run() == [broken, none, one, other]
    assert run() == [broken, none, one, other]  # nothing is read twice
    transcript("two.json", "third.")
    two = ("two.json", "two", "ok", None, 1, 0)
    assert run() == [broken, none, one, other, two]
    transcript("broken.json", "mended.")
    assert ingest.retry_failed(spark, home["out"], home["ledger"]) == 2
    mended, tried = ("broken.json", "broken", "ok", None, 1, 1), ("other.json", "other", "error", "no segments", None, 1)
    assert run() == [mended, none, one, tried, two]
    got = ingest.ingested_segments(spark, home["out"], home["ledger"]).collect()
    assert sorted((r["stream_id"], r["text"]) for r in got) == [
        ("broken", "mended."), ("one (a)", "first."), ("one (a)", "second."), ("two", "third.")]


def test_triage_writes_an_ordered_sheet(spark, tmp_path):
    verse = "let brotherly love continue among you always"
    lines = [f"{verse},,,", "the market closed higher,,,negative", ",,,", "nothing like it at all here,,,", f"{verse},,,positive",
             "love may continue among friends,,,", "open,,,positive"]
    path = _write(tmp_path / "t.csv", "text,verse,x,label\n" + "\n".join(lines) + "\n")
    p = spark.createDataFrame([(1, "AMP", "Hebrews", 13, 1, verse), (2, "NKJV", "Ezra", 1, 1, "quick brown foxes jump")],
                              "passage_id long, edition string, work string, section int, item int, text string")
    out = str(tmp_path / "sheet")
    outcomes = {r["outcome"]: r["n"] for r in detection.triage_csv(spark, path, p, out).collect()}
    assert outcomes == {"caught": 1, "missed": 1, "rejected": 1}
    rows = []
    for part in sorted((tmp_path / "sheet").glob("part-*")):
        with open(part, newline="") as file:
            rows += list(csv.DictReader(file))
    assert list(rows[0]) == triage.OUT_COLUMNS
    assert [r["label"] for r in rows] == ["negative", "positive", "positive", "", "", ""]
    assert [r["text"] for r in rows[:3]] == ["the market closed higher", verse, "open"]
    assert rows[3]["text"] == verse and rows[3]["suggested_verse"] == "Hebrews 13:1"
    scores = [float(r["confidence"] or 0) for r in rows[3:]]
    assert scores == sorted(scores, reverse=True)
