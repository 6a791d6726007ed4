"""Stacking: a final model on predictions for rows that the members were not fitted on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.ml import Transformer
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from tabwright.operators.models import trees
from tabwright.operators.models.recipe import FEATURES, LABEL, Fit, Task, chain, folds, row_count
from tabwright.operators.models.trees import Spec, TreeStage
from tabwright.operators.stats import aggregate_once
from tabwright.session import checkpointed

Members = dict[str, Callable[[DataFrame, Task], list[Transformer]]]  # name -> fitted stages


def _classifier(cls, name: str, label: str = LABEL, **params):
    return cls(featuresCol=FEATURES, labelCol=label, predictionCol=f"_{name}_p", **params).setProbabilityCol(
        f"_{name}_prob").setRawPredictionCol(f"_{name}_raw")


def _regressor(cls, name: str, **params):
    return cls(featuresCol=FEATURES, labelCol=LABEL, predictionCol=f"_{name}_p", **params)


def default_classifiers(trees: int = 100, depth: int = 15) -> Members:
    return {"tree": lambda rows, task: [_classifier(DecisionTreeClassifier, "tree", maxDepth=depth, seed=task.seed).fit(rows)],
            "forest": lambda rows, task: [_classifier(RandomForestClassifier, "forest", numTrees=trees, maxDepth=depth,
                                                      seed=task.seed).fit(rows)]}


def _boosted(rows: DataFrame, task: Task, trees: int, rate: float = 0.1) -> list[Transformer]:
    """Boosted trees with two outputs; beyond two classes one model per class, their outputs side by side."""
    def one(name: str, label: str = LABEL):
        return _classifier(GBTClassifier, name, label, maxIter=trees, maxDepth=3, stepSize=rate, seed=task.seed)
    if task.classes <= 2:
        return [one("boost").fit(rows)]
    models = [one(f"boost{k}", "_is").fit(rows.withColumn("_is", (F.col(LABEL) == k).cast("double"))) for k in range(task.classes)]
    return [*models, VectorAssembler(inputCols=[f"_boost{k}_prob" for k in range(task.classes)], outputCol="_boost_prob")]


def tuned_classifiers(forest_trees: int, boosted_trees: int, C: float, depth: int = 5, rate: float = 0.1) -> Members:
    """Forest, boosting (unless ``boosted_trees`` is 0) and logistic members."""
    return {"forest": lambda rows, task: [_classifier(RandomForestClassifier, "forest", numTrees=forest_trees,
                                                      maxDepth=depth, seed=task.seed).fit(rows)],
            **({"boost": lambda rows, task: _boosted(rows, task, boosted_trees, rate)} if boosted_trees else {}),
            "line": lambda rows, task: [_classifier(LogisticRegression, "line", regParam=1.0 / (max(C, 1e-9) * row_count(rows)),
                                                    standardization=False).fit(rows)]}


def default_regressors(forest: int = 350, boosted: int = 100, extra: int = 25, depth: int = 15, rate: float = 0.1,
                       extra_rate: float = 0.3) -> Members:
    return {"forest": lambda rows, task: [_regressor(RandomForestRegressor, "forest", numTrees=forest, maxDepth=depth,
                                                     featureSubsetStrategy="0.75", subsamplingRate=0.5, seed=task.seed).fit(rows)],
            "boost": lambda rows, task: [_regressor(GBTRegressor, "boost", maxIter=boosted, maxDepth=3, stepSize=rate,
                                                    featureSubsetStrategy="0.5", seed=task.seed).fit(rows)],
            "quick": lambda rows, task: [_regressor(GBTRegressor, "quick", maxIter=extra, maxDepth=5, stepSize=extra_rate,
                                                    seed=task.seed).fit(rows)]}


def _out_of_fold(data: DataFrame, task: Task, members: Members, k: int) -> DataFrame:
    """Every row with the members' outputs, each computed without that row's fold."""
    split = folds(data, task, k, level=2)
    parts = None
    for f in range(k):
        train, rest = split.where(F.col("_fold") != f), split.where(F.col("_fold") == f)
        if rest.isEmpty():
            continue
        for make in members.values():
            rest = chain(make(train, task), rest)
        parts = rest if parts is None else parts.unionByName(rest)
    return checkpointed(parts)


def _finish(data: DataFrame, task: Task, members: Members, k: int, outputs: list[str], final) -> list[Transformer]:
    joined = VectorAssembler(inputCols=outputs, outputCol="_meta")
    seen = joined.transform(_out_of_fold(data, task, members, k))
    top = final(seen, task).fit(seen)
    return [*[stage for make in members.values() for stage in make(data, task)], joined, top]


def stack_classifiers(members: Members | None = None, k: int = 5, C: float = 1.0, final: str = "logistic") -> Fit:
    members = members or default_classifiers()

    def top(seen: DataFrame, task: Task):
        columns = {"featuresCol": "_meta", "labelCol": LABEL, "predictionCol": "_prediction",
                   "probabilityCol": "_probability", "rawPredictionCol": "_raw"}
        if final == "forest":
            return RandomForestClassifier(**columns, seed=task.seed)
        return LogisticRegression(**columns, regParam=1.0 / (C * row_count(seen)), standardization=False)
    return lambda data, task: _finish(data, task, members, k, [f"_{m}_prob" for m in members], top)


def regressor_specs(forest: int = 350, boosted: int = 100, extra: int = 25, depth: int = 15) -> dict[str, Spec]:
    return {"forest": Spec("forest", trees=forest, depth=depth, features=0.75, rows=0.5),
            "boost": Spec("boost", trees=boosted, depth=3, rate=0.1, features=0.5),
            "quick": Spec("boost", trees=extra, depth=5, rate=0.3, impurity="second", l2=1.0, min_child=1.0)}


def _finish_specs(data: DataFrame, task: Task, specs: dict[str, Spec], k: int, final) -> list[Transformer]:
    """One binned table serves all (member, fold) fits, which are in flight together; then each member on all rows."""
    split = folds(data, task, k, level=2)
    table = trees.binned(split, task.key, task.features, LABEL, trees.bin_edges(split, task.features))
    fits = [(replace(s, seed=task.seed), f) for s in specs.values() for f in range(k)]
    outputs = [f"_{m}_p" for m in specs]
    wide = trees.out_of_fold(table, len(task.features), fits).groupBy("_row").agg(
        F.first("_y").alias(LABEL), *[F.max(F.when(F.floor(F.col("fit") / k) == i, F.col("_p"))).alias(o) for i, o in enumerate(outputs)])
    joined = VectorAssembler(inputCols=outputs, outputCol="_meta")
    seen = joined.transform(checkpointed(wide.dropna()))
    stages = [TreeStage(trees.fit_model(data, task.key, task.features, LABEL, replace(s, seed=task.seed)), o)
              for s, o in zip(specs.values(), outputs)]
    return [*stages, joined, final(seen, task).fit(seen)]


def stack_regressors(members: Members | None = None, k: int = 5, alpha: float = 100.0, final: str = "ridge") -> Fit:
    """Without ``members``, the ones of ``regressor_specs``, grown side by side; rows are told apart by the task's key."""
    def top(seen: DataFrame, task: Task):
        columns = {"featuresCol": "_meta", "labelCol": LABEL, "predictionCol": "_prediction"}
        if final == "forest":
            return RandomForestRegressor(**columns, seed=task.seed)
        if final == "linear":
            return LinearRegression(**columns, regParam=0.0)
        s = aggregate_once(seen, {"n": F.count(F.lit(1)), "d": F.stddev_pop(LABEL)})
        return LinearRegression(**columns, elasticNetParam=0.0, standardization=False, solver="normal",
                                regParam=alpha * s["d"] / s["n"])
    if members is None:
        return lambda data, task: _finish_specs(data, task, regressor_specs(), k, top)
    return lambda data, task: _finish(data, task, members, k, [f"_{m}_p" for m in members], top)
