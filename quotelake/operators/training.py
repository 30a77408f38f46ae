"""Preparation, training and evaluation of the binary text classifier with Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ordered
from .ordered import CHUNK, Axis

BUCKET_BITS = 20


def keep_first_texts(rows: DataFrame, order: str) -> DataFrame:
    """First row of every text, then rows without text or label removed. `order` is unique.

    Texts meet as digests and only their first places are shuffled; a text is read again from its row.
    """
    key = F.coalesce(F.md5("text"), F.lit(""))
    first = rows.groupBy(key.alias("_text")).agg(F.min(order).alias(order)).select(order)
    return rows.join(first, order, "left_semi").na.drop(subset=["label", "text"])


def removed_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before, kept and removed, as one row."""
    tagged = before.select(F.lit("before").alias("side")).unionByName(
        after.select(F.lit("kept").alias("side"))
    )
    return tagged.agg(
        F.count_if(F.col("side") == "before").alias("n_before"),
        F.count_if(F.col("side") == "kept").alias("n_kept"),
    ).withColumn("n_removed", F.col("n_before") - F.col("n_kept"))


def stratified_split(
    rows: DataFrame, label: str = "label", text: str = "text", fraction: float = 0.10, seed: int = 42
) -> DataFrame:
    """Add `is_validation` for exactly ceil(fraction * n) rows of each label, by seeded text digest.

    Two labels mean two huge groups, so no window ranks a label. Rows fall into 2^20 hash
    buckets; the counts per bucket say which bucket the cut falls into, and only the rows of that
    one bucket are ranked. Texts are expected to be distinct.
    """
    df = rows.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(text)))).withColumn(
        "_bucket", F.conv(F.substring("_h", 1, BUCKET_BITS // 4), 16, 10).cast("long")
    )
    counts = df.groupBy(label, "_bucket").agg(F.count("*").alias("_n"))
    sizes = counts.groupBy(label).agg(F.ceil(F.round(F.sum("_n") * fraction, 9)).alias("_want"))
    below = ordered.running_sum(counts, Axis((label,), ("_bucket",)), F.col("_n"), "_below")
    cut = (
        below.join(sizes, label)
        .filter((F.col("_below") < F.col("_want")) & (F.col("_below") + F.col("_n") >= F.col("_want")))
        .select(label, F.col("_bucket").alias("_cut"), (F.col("_want") - F.col("_below")).alias("_left"))
    )
    # one row per label
    df = df.join(F.broadcast(cut), label)
    edge = df.filter(F.col("_bucket") == F.col("_cut"))
    ranked = edge.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy("_h", text)))
    inside = ranked.withColumn("is_validation", F.col("_r") <= F.col("_left")).drop("_r")
    rest = df.filter(F.col("_bucket") != F.col("_cut")).withColumn(
        "is_validation", F.col("_bucket") < F.col("_cut")
    )
    return inside.unionByName(rest).drop("_h", "_bucket", "_cut", "_left", CHUNK)


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights n / (classes * n_class)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"), F.count("*").alias("_k")).withColumn("_one", F.lit(1))
    joined = counts.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")
    return joined.select(label, "n", (F.col("_total") / (F.col("_k") * F.col("n"))).alias("weight"))


def binary_metrics(rows: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Accuracy, precision, recall and F1 of 0/1 columns; a zero denominator gives 0."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    cells = rows.agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"),
    )

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cells.select(
        "tp", "fp", "fn", "tn",
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def confusion(rows: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Confusion matrix: one row per label, one column per prediction."""
    wide = rows.groupBy(label).pivot(pred, [0, 1]).agg(F.count(F.lit(1)))
    return wide.select(
        label, F.coalesce("0", F.lit(0)).alias("pred_0"), F.coalesce("1", F.lit(0)).alias("pred_1")
    )


def train(rows: DataFrame, features: int = 1 << 16, reg: float = 0.01, max_iter: int = 30) -> PipelineModel:
    """Weighted logistic regression on hashed TF-IDF; `rows` holds `text` and 0/1 `label`."""
    weights = class_weights(rows).select("label", "weight")
    data = rows.join(F.broadcast(weights), "label")
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="text", outputCol="_tok", pattern=r"[^\p{L}\p{N}']+"),
            HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=features),
            IDF(inputCol="_tf", outputCol="_x"),
            LogisticRegression(
                featuresCol="_x", labelCol="label", weightCol="weight", regParam=reg, maxIter=max_iter
            ),
        ]
    ).fit(data)


def select_by_f1(train_rows: DataFrame, val_rows: DataFrame, regs: list[float]) -> PipelineModel:
    """Train one model per regularisation value and keep the best validation F1."""
    best, best_f1 = None, -1.0
    for reg in regs:
        model = train(train_rows, reg=reg)
        f1 = binary_metrics(score(model, val_rows)).first()["f1"]
        if f1 > best_f1:
            best, best_f1 = model, f1
    return best


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Positive probability capped at 0.99 and 0/1 prediction."""
    out = model.transform(rows)
    prob = F.least(F.lit(0.99), vector_to_array("probability").getItem(1))
    hidden = ["_tok", "_tf", "_x", "rawPrediction", "probability"]
    return out.withColumn("model_prob", prob).withColumn(
        "prediction", F.col("prediction").cast("int")
    ).drop(*hidden)


def scorer(model: PipelineModel):
    """The model as a scorer of the detection gates: adds `model_prob` for any text column."""
    def add(df: DataFrame, text: str) -> DataFrame:
        renamed = df.withColumnsRenamed({"text": "_own_text"} if "text" in df.columns and text != "text" else {})
        scored = score(model, renamed.withColumn("text", F.coalesce(text, F.lit(""))))
        out = scored.drop("prediction") if text == "text" else scored.drop("prediction", "text")
        return out.withColumnsRenamed({"_own_text": "text"})

    return add


def class_report(rows: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support of every class; a zero denominator gives 0."""
    pairs = rows.groupBy(label, pred).agg(F.count("*").alias("n"))
    sides = pairs.select(F.col(label).alias("class"), F.col("n").alias("support"), F.lit(0).alias("predicted"),
                         F.when(F.col(label) == F.col(pred), F.col("n")).otherwise(0).alias("hit"))
    sides = sides.unionByName(pairs.select(F.col(pred).alias("class"), F.lit(0).cast("long").alias("support"),
                                           F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hit")))
    total = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hit")])

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    hit, support, predicted = (F.col(c) for c in ("hit", "support", "predicted"))
    return total.select(
        "class", ratio(hit, predicted).alias("precision"), ratio(hit, support).alias("recall"),
        ratio(2 * hit, support + predicted).alias("f1"), "support",
    )
