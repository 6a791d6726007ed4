"""AdaBoost by reweighting: SAMME for classes, R2 for numbers.

Weights live in a column of the training table. Every few rounds the table is
checkpointed, so that its plan does not grow with the number of rounds and a lost
executor costs a few rounds only.
"""

from __future__ import annotations

from math import log

from pyspark.ml import Transformer
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame, functions as F

from tabwright.operators.models.recipe import FEATURES, LABEL, Fit, Task, projection, sql_number
from tabwright.operators.stats import aggregate_once
from tabwright.session import checkpointed

ROUNDS_PER_CHECKPOINT = 5


def adaboost_classifier(trees: int = 50, rate: float = 1.0, depth: int = 1) -> Fit:
    """Each round weighs the misclassified rows up; the vote of a tree is rate (ln((1 - e) / e) + ln(K - 1))."""
    def fit(data: DataFrame, task: Task) -> list[Transformer]:
        classes = max(2, task.classes)
        rows = data.select(FEATURES, LABEL, F.lit(1.0).alias("_w"))
        stages, votes = [], []
        for t in range(trees):
            tree = DecisionTreeClassifier(featuresCol=FEATURES, labelCol=LABEL, weightCol="_w", maxDepth=depth,
                                          predictionCol=f"_p{t}", rawPredictionCol=f"_raw{t}",
                                          probabilityCol=f"_prob{t}", seed=task.seed + t).fit(rows)
            missed = (F.col(f"_p{t}") != F.col(LABEL)).cast("double")
            judged = tree.transform(rows).withColumn("_miss", missed).drop(f"_p{t}", f"_raw{t}", f"_prob{t}")
            s = aggregate_once(judged, {"e": F.sum(F.col("_w") * F.col("_miss")), "w": F.sum("_w")})
            error = s["e"] / s["w"]
            if error >= 1 - 1 / classes:
                if not stages:
                    stages, votes = [tree], [1.0]
                break
            stages.append(tree)
            if error <= 0:
                votes.append(1.0 if len(votes) == 0 else 10 * max(votes))
                break
            votes.append(rate * (log((1 - error) / error) + log(classes - 1)))
            rows = judged.withColumn("_w", F.col("_w") * F.exp(votes[-1] * F.col("_miss")) / s["w"]).drop("_miss")
            if (t + 1) % ROUNDS_PER_CHECKPOINT == 0:
                rows = checkpointed(rows)
        scores = ", ".join(" + ".join(
            f"CASE WHEN {s.getPredictionCol()} = {k} THEN {sql_number(v)} ELSE 0D END" for s, v in zip(stages, votes))
            for k in range(classes))
        return [*stages, projection(f"array({scores}) AS _votes"),
                projection("CAST(array_position(_votes, array_max(_votes)) - 1 AS DOUBLE) AS _prediction")]
    return fit


def adaboost_regressor(trees: int = 50, rate: float = 1.0, depth: int = 3, loss: str = "linear") -> Fit:
    """Rows the last tree got right lose weight; the prediction is the weighted median over the trees."""
    if loss not in ("linear", "square", "exponential"):
        raise ValueError(f"unknown loss {loss}")

    def fit(data: DataFrame, task: Task) -> list[Transformer]:
        rows = data.select(FEATURES, LABEL, F.lit(1.0).alias("_w"))
        stages, weights = [], []
        for t in range(trees):
            tree = DecisionTreeRegressor(featuresCol=FEATURES, labelCol=LABEL, weightCol="_w", maxDepth=depth,
                                         predictionCol=f"_p{t}", seed=task.seed + t).fit(rows)
            judged = tree.transform(rows).withColumn("_e", F.abs(F.col(f"_p{t}") - F.col(LABEL))).drop(f"_p{t}")
            worst = aggregate_once(judged, {"m": F.max("_e")})["m"]
            if not worst:
                stages, weights = [*stages, tree], [*weights, 1.0 if not weights else 10 * max(weights)]
                break
            share = F.col("_e") / worst
            judged = judged.withColumn("_l", {"linear": share, "square": share * share,
                                              "exponential": 1 - F.exp(-share)}[loss])
            s = aggregate_once(judged, {"a": F.sum(F.col("_w") * F.col("_l")), "w": F.sum("_w")})
            mean_loss = s["a"] / s["w"]
            if mean_loss >= 0.5:
                if not stages:
                    stages, weights = [tree], [1.0]
                break
            beta = mean_loss / (1 - mean_loss)
            stages.append(tree)
            weights.append(rate * log(1 / beta))
            rows = judged.withColumn("_w", F.col("_w") * F.pow(F.lit(beta), (1 - F.col("_l")) * rate) / s["w"]).drop(
                "_e", "_l")
            if (t + 1) % ROUNDS_PER_CHECKPOINT == 0:
                rows = checkpointed(rows)
        pairs = ", ".join(f"named_struct('p', {s.getPredictionCol()}, 'w', {sql_number(w)})" for s, w in zip(stages, weights))
        half = sql_number(sum(weights) / 2)
        median = (f"aggregate(array_sort(array({pairs})), named_struct('c', 0D, 'v', CAST(NULL AS DOUBLE)), "
                  f"(a, x) -> IF(a.c >= {half}, a, named_struct('c', a.c + x.w, 'v', x.p)), a -> a.v)")
        return [*stages, projection(f"{median} AS _prediction")]
    return fit
