import pytest
from pyspark.sql import functions as F

from quotelake import lexicons as L
from quotelake.functions import signals as S
from quotelake.operators import detect

YES = [
    "The Bible says to love one another.", "As it is written, the just shall live.",
    "Turn to Romans 8:28 this morning.", "Open at 1 Corinthians 13:4 please.", "We meet at 10:30 today.",
    "Isaiah declares the glory of it.", "I am with you, says the Lord of hosts.",
    "The apostle Paul tells us to stand.", "In Romans we learn patience.",
    "We are studying Second Timothy now.", "My job was hard.",
]
NO = [
    "My teacher says sums are hard.", "The news says prices rise.", "Mr Johnson came to dinner.",
    "He markedly improved.", "We should have faith and hope.", "Samuel went home.",
    "Behold the lamb that taketh away.", "",
]


def test_rule_cases(spark):
    rows = [(t, True) for t in YES] + [(t, False) for t in NO]
    df = detect.rule_gate(spark.createDataFrame(rows, "candidate_text string, expected boolean"))
    wrong = df.filter((F.col("quote_prob") >= 0.40) != F.col("expected")).collect()
    assert wrong == []
    assert df.filter("quote_prob < 0 OR quote_prob > 1").count() == 0


def test_all_works_fire(spark):
    df = spark.createDataFrame([(f"we read from {w} today",) for w in L.WORKS], "t string")
    assert df.filter(~S.names_work(F.col("t"))).count() == 0


@pytest.mark.parametrize(
    "text,count,source", [("Paul writes in Romans 8:28.", 4, "cue"), ("nothing here", 0, "none")]
)
def test_counts_and_source(spark, text, count, source):
    df = S.with_signals(spark.createDataFrame([(text,)], "t string"), "t")
    row = df.select(S.signal_count().alias("n"), S.signal_source().alias("s")).first()
    assert (row["n"], row["s"]) == (count, source)


def test_hybrid_only_sends_silent_rows_to_the_model(spark):
    df = spark.createDataFrame([("The Bible says so.",), ("plain words here",)], "candidate_text string")
    scored = detect.hybrid_gate(df, detect.column_scorer(lambda c: F.when(c.contains("Bible"), F.raise_error(F.lit("called"))).otherwise(0.7)))
    got = {r["source"]: r["quote_prob"] for r in scored.collect()}
    # cue and attribution both fire
    assert got == {"cue": pytest.approx(0.95), "model": 0.7}
    assert detect.hybrid_gate(df, None).filter("source = 'none'").first()["quote_prob"] == 0.05


def test_a_trained_model_can_gate(spark):
    from quotelake.operators import training

    rows = [(f"the bible says {i}", 1) for i in range(20)] + [(f"weather and news {i}", 0) for i in range(20)]
    scorer = training.scorer(training.train(spark.createDataFrame(rows, "text string, label int"), max_iter=5))
    windows = spark.createDataFrame([("weather news", "own"), ("bible says", "own")], "candidate_text string, text string")
    got = {r["candidate_text"]: r for r in detect.model_gate(windows, scorer).collect()}
    assert got["bible says"]["quote_prob"] > 0.5 > got["weather news"]["quote_prob"]
    assert got["bible says"]["text"] == "own"
