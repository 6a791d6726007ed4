"""Scores of predictions against the truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabwright.functions.columns import quoted
from tabwright.operators.stats import average_ranks
from tabwright.session import checkpointed


def _pair_counts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(quoted(actual).cast("string").alias("actual"), quoted(predicted).cast("string").alias(
        "predicted")).agg(F.count("*").alias("k"))


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, n) for every pair of labels seen on either side, 0 included; a missing label is one of its own."""
    counts = checkpointed(_pair_counts(df, actual, predicted))
    labels = counts.select(F.explode(F.array("actual", "predicted")).alias("l")).distinct()
    grid = labels.select(F.col("l").alias("actual")).crossJoin(labels.select(F.col("l").alias("predicted")))
    same = grid["actual"].eqNullSafe(counts["actual"]) & grid["predicted"].eqNullSafe(counts["predicted"])
    return grid.join(counts, same, "left").select(
        grid["actual"], grid["predicted"], F.coalesce("k", F.lit(0)).cast("long").alias("n"))


def classification_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(label, precision, recall, f1, support) per class, then accuracy, macro avg and weighted avg.

    A ratio without a denominator counts as 0.
    """
    counts = _pair_counts(df, actual, predicted)
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("k")).otherwise(0)
    sides = counts.select(F.explode(F.array(
        F.struct(F.col("actual").alias("label"), F.col("k").alias("truth"), F.lit(0).cast("long").alias("guess"),
                 hit.alias("hit")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("truth"), F.col("k").alias("guess"),
                 F.lit(0).cast("long").alias("hit")))).alias("s")).select("s.*")
    t = sides.groupBy("label").agg(F.sum("truth").alias("support"), F.sum("guess").alias("guess"),
                                   F.sum("hit").alias("hit"))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))
    t = t.withColumns({"precision": ratio(F.col("hit"), F.col("guess")), "recall": ratio(F.col("hit"), F.col("support"))})
    t = t.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    three = ("precision", "recall", "f1")
    per_class = t.select("label", *three, "support")
    summary = t.agg(F.sum("support").alias("n"), F.sum("hit").alias("hits"),
                    *[F.avg(c).alias(f"m_{c}") for c in three],
                    *[ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"w_{c}") for c in three])
    accuracy = ratio(F.col("hits"), F.col("n"))
    lines = F.array(
        F.struct(F.lit("accuracy").alias("label"), *[accuracy.alias(c) for c in three], F.col("n").alias("support")),
        F.struct(F.lit("macro avg").alias("label"), *[F.col(f"m_{c}").alias(c) for c in three],
                 F.col("n").alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), *[F.col(f"w_{c}").alias(c) for c in three],
                 F.col("n").alias("support")))
    return per_class.union(summary.select(F.explode(lines).alias("l")).select("l.*"))


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.agg(F.avg((quoted(actual) == quoted(predicted)).cast("int")).alias("accuracy"))


def r2_mae(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(r2, mae, mse)."""
    y, f = quoted(actual).cast("double"), quoted(predicted).cast("double")
    return df.agg(F.avg(F.pow(y - f, 2)).alias("mse"), F.avg(F.abs(y - f)).alias("mae"),
                  F.var_pop(F.when(f.isNotNull(), y)).alias("_v")).select(
        (1 - F.try_divide("mse", "_v")).alias("r2"), "mae", "mse")


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve from the rank sum of the positives; tied scores share their mean rank."""
    cells = df.groupBy(quoted(score).cast("double").alias("value")).agg(
        F.count("*").alias("n"), F.sum(quoted(label).cast("long")).alias("pos"))
    s = average_ranks(cells).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"),
                                 F.sum(F.col("n") - F.col("pos")).alias("q"))
    p, q = F.col("p").cast("double"), F.col("q").cast("double")
    return s.select(F.try_divide(F.col("r") - p * (p + 1) / 2, p * q).alias("roc_auc"))


def cv_scorers(df: DataFrame, label: str, predicted: str, score: str) -> DataFrame:
    """(metric, value): accuracy, precision, recall, f1, roc_auc of a 0/1 label, and the regression scores of ``score``."""
    y, f = quoted(label) == 1, quoted(predicted) == 1
    s, t = quoted(score).cast("double"), quoted(label).cast("double")
    base = df.agg(F.avg((quoted(label) == quoted(predicted)).cast("int")).alias("accuracy"),
                  F.count_if(y & f).alias("tp"), F.count_if(f).alias("g"), F.count_if(y).alias("p"),
                  (-F.avg(F.pow(t - s, 2))).alias("neg_mean_squared_error"),
                  (-F.avg(F.abs(t - s))).alias("neg_mean_absolute_error"), F.var_pop(t).alias("v"))

    def ratio(a, b):
        return F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    wide = base.withColumns({"precision": ratio("tp", "g"), "recall": ratio("tp", "p"),
                             "f1": F.coalesce(F.try_divide(2 * F.col("tp"), F.col("g") + F.col("p")), F.lit(0.0)),
                             "r2": 1 + F.try_divide("neg_mean_squared_error", "v")})
    names = ["accuracy", "precision", "recall", "f1", "neg_mean_squared_error", "neg_mean_absolute_error", "r2"]
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])
    return wide.select(F.explode(rows).alias("r")).select("r.*").union(
        roc_auc(df, label, score).select(F.lit("roc_auc"), F.col("roc_auc")))


def softmax_top_k(df: DataFrame, key: str, scores: str, k: int = 5) -> DataFrame:
    """(key, rank, index, probability): the ``k`` largest softmax values of a score array, ties by index."""
    s = quoted(scores)
    top = F.array_max(s)
    weights = F.transform(s, lambda x: F.exp(x.cast("double") - top.cast("double")))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    ranked = F.array_sort(F.transform(weights, lambda x, i: F.struct((-x).alias("w"), i.alias("index"))))
    return df.select(quoted(key), total.alias("_t"), F.posexplode(F.slice(ranked, 1, k))).select(
        quoted(key), (F.col("pos") + 1).alias("rank"), F.col("col.index").alias("index"),
        (-F.col("col.w") / F.col("_t")).alias("probability"))


def confidence_filter(df: DataFrame, score: str, threshold: float = 0.5) -> DataFrame:
    return df.where(quoted(score) >= threshold)
