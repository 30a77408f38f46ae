"""The pipeline and the numbered queries on the smallest tables."""

import duckdb
import pytest

import check
import corpus_pipeline
from quotelake.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    line = check.compare(spark, con, name, QUERIES[name], ORACLE[name], SF)
    assert line.startswith("ok") and "types differ" not in line, line


def test_language_query_is_right_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    held = QUERIES["op5_language_id"](spark, SF).where("held_out").join(docs, "doc_id")
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count() > 0


def test_stages_take_effect_in_order(spark):
    rng = __import__("random").Random(5)
    words = {"en": ["the", "and", "house", "water"], "de": ["der", "und", "haus", "wasser"]}

    def text(lang, n):
        return " ".join(rng.choice(words[lang]) + str(rng.choice("abcdefgh")) for _ in range(n))

    docs = [(i, text("en" if i % 2 else "de", 200), "en" if i % 2 else "de", "s", 0) for i in range(60)]
    line = "a boilerplate line in many documents"
    docs = [(i, t + "\n" + line if i < 9 else t, *rest) for i, t, *rest in docs]
    docs += [(100, None, "en", "s", 0), (101, "123 !", "en", "s", 0), (102, docs[50][1], "de", "s", 0)]
    docs += [(103, text("en", 50) + " password=hunter2hunter2", "en", "s", 0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, SF)
        frame = spark.createDataFrame(frame.collect(), frame.schema)
        kept[name] = {r.doc_id: r for r in frame.collect()}
        if name != "packing":
            assert frame.columns == corpus_pipeline.DOCUMENT_COLUMNS
    ids = set(range(60))
    assert set(kept["language_id"]) == ids | {102, 103}
    assert sum(line in r.text for r in kept["line_dedup"].values()) == 1
    assert set(kept["near_dedup"]) == ids | {103}
    assert "hunter2" not in kept["secret_scan"][103].text
    assert all(r.n_chars == len(r.text) for r in kept["secret_scan"].values())
    assert set(kept["packing"]) == set(kept["secret_scan"])


def test_pipeline_runs_on_an_empty_and_a_small_table(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0
    frame = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, SF)
        assert frame.count() == 0


def test_no_repeated_line_is_left_in_documents_that_stay(spark):
    def lines(name, n):
        return [" ".join(f"{name}{k}word{j}" for j in range(12)) for k in range(n)]

    shared = [lines(name, 3) for name in ("uno", "due", "tre")]
    texts = [part + lines(f"own{i}x", 6) for i, part in enumerate(shared)]
    texts.append(shared[0] + lines("half", 3))                   # half of it stands in another document
    texts.append(shared[0] + shared[1] + shared[2] + lines("few", 1))  # nine tenths, from three documents
    texts.append(texts[0][:-1] + lines("near", 1))               # a near copy of the first
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, "\n".join(t), "en", "s", 0) for i, t in enumerate(texts)]
    out = corpus_pipeline.near_dedup(
        spark, corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, schema), SF), SF)
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == {0, 1, 2, 3, 4}
    assert got[3].text == "\n".join(lines("half", 3)) and got[4].text == lines("few", 1)[0]
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_equal_rows_do_not_add_to_what_repeats(spark):
    line, body = "a line that stands in several documents", "own " * 60
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(0, line + "\nfirst", "en", "s", 0), *[(1, line + "\n" + body, "en", "s", 0)] * 3]
    out = corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, schema), SF).where("doc_id = 1").collect()
    assert [r.text for r in out] == [body] * 3


def test_near_dedup_takes_any_column_names(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, text if i < 2 else f"{i} other words", "en", "s", 1, "id", "k") for i in range(4)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, id string, k string"
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, kind), "")
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 2, 3]
