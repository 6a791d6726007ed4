"""Classifiers. Each function returns the fitting step of one model."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Estimator, Transformer
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       OneVsRest, RandomForestClassifier)
from pyspark.ml.feature import PolynomialExpansion
from pyspark.sql import DataFrame, functions as F

from tabwright.operators.models.cells import drawn_features
from tabwright.operators.models.kernels import fourier_stages
from tabwright.operators.models.recipe import (FEATURES, LABEL, Fit, Task, balanced_weights, chain, projection,
                                              row_count, scaled_names, sql_number)
from tabwright.operators.models.trees import Spec, TreeStage, fit_dealt

MAX_TREE_DEPTH = 30
COLUMNS = {"featuresCol": FEATURES, "labelCol": LABEL, "predictionCol": "_prediction"}


def hidden(prefix: str = "") -> dict:
    """Probability outputs under names that do not stay in the result."""
    return {"probabilityCol": f"_{prefix}probability", "rawPredictionCol": f"_{prefix}raw"}


def direct(make, class_weight: str | None = None) -> Fit:
    """Fit a single estimator, optionally with balanced class weights."""
    def fit(data: DataFrame, task: Task) -> list[Transformer]:
        rows = balanced_weights(data) if class_weight == "balanced" else data
        estimator: Estimator = make(rows, task)
        if class_weight == "balanced":
            estimator = estimator.copy({estimator.getParam("weightCol"): "_weight"})
        return [estimator.fit(rows)]
    return fit


def logistic(C: float = 1.0, max_iter: int = 100, penalty: str = "l2", l1_ratio: float = 0.5,
             class_weight: str | None = None) -> Fit:
    """``C`` is the inverse strength of the penalty on the summed loss, hence 1 / (C n) on the mean."""
    mix = {"l2": 0.0, "l1": 1.0, "elasticnet": l1_ratio, "none": 0.0}[penalty]

    def make(rows: DataFrame, task: Task) -> LogisticRegression:
        strength = 0.0 if penalty == "none" else 1.0 / (C * row_count(rows))
        return LogisticRegression(**COLUMNS, **hidden(), regParam=strength, elasticNetParam=mix, maxIter=max_iter,
                                  standardization=False)
    return direct(make, class_weight)


def random_forest(trees: int = 100, depth: int = 15, max_features: str = "0.75", min_leaf: int = 1,
                  class_weight: str | None = None) -> Fit:
    """Each row counts a Poisson number of times in a tree; a tree's rows meet in a task, beyond ``trees.dealtCells`` values
    Spark's learner takes them."""
    plain = direct(lambda rows, task: RandomForestClassifier(
        **COLUMNS, **hidden(), numTrees=trees, maxDepth=min(depth, MAX_TREE_DEPTH), featureSubsetStrategy=max_features,
        minInstancesPerNode=min_leaf, seed=task.seed), class_weight)

    def fit(data: DataFrame, task: Task) -> list[Transformer]:
        if task.scaler == "normalizer" or task.classes < 2 or trees < 2:
            return plain(data, task)
        names = scaled_names(task)
        spec = Spec("forest", task.classes, trees, min(depth, MAX_TREE_DEPTH), min_leaf=min_leaf, rows="bootstrap", impurity="gini",
                    features=(drawn_features(max_features, len(names)) + 0.5) / len(names), balanced=class_weight == "balanced", seed=task.seed)
        model = fit_dealt(data, task.key, names, LABEL, spec)
        return [TreeStage(model, "_prediction")] if model else plain(data, task)
    return fit


def decision_tree(depth: int = 15, min_split: int = 2, min_leaf: int = 1, impurity: str = "gini",
                  class_weight: str | None = None) -> Fit:
    """A node of fewer than ``min_split`` rows is not split: each side keeps at least half of that."""
    return direct(lambda rows, task: DecisionTreeClassifier(
        **COLUMNS, **hidden(), maxDepth=min(depth, MAX_TREE_DEPTH), impurity=impurity,
        minInstancesPerNode=max(min_leaf, min_split // 2), seed=task.seed), class_weight)


def one_per_class(base: Estimator, task: Task, features: str = FEATURES) -> Estimator:
    """A two-class estimator as is, or one model per class."""
    base = base.setRawPredictionCol("_raw")
    if task.classes <= 2:
        return base.setPredictionCol("_prediction")
    return OneVsRest(classifier=base, featuresCol=features, labelCol=LABEL, predictionCol="_prediction",
                     rawPredictionCol="_raw", parallelism=4)


def gradient_boosting(trees: int = 100, rate: float = 0.1, depth: int = 3, min_leaf: int = 1,
                      subsample: float = 1.0) -> Fit:
    return direct(lambda rows, task: one_per_class(GBTClassifier(
        featuresCol=FEATURES, labelCol=LABEL, maxIter=trees, stepSize=rate, maxDepth=depth, minInstancesPerNode=min_leaf,
        subsamplingRate=subsample, seed=task.seed).setProbabilityCol("_probability"), task))


def svm(C: float = 1.0, kernel: str = "linear", degree: int = 3, dimensions: int = 100, max_iter: int = 100) -> Fit:
    """Linear machine on the features, on their polynomial expansion, or on random Fourier features (rbf)."""
    if kernel not in ("linear", "poly", "rbf"):
        raise ValueError(f"kernel {kernel} is not offered")

    def fit(data: DataFrame, task: Task) -> list[Transformer]:
        stages: list[Transformer] = []
        names = scaled_names(task) if kernel == "linear" and task.scaler != "normalizer" else None
        if kernel == "poly":
            stages = [PolynomialExpansion(degree=degree, inputCol=FEATURES, outputCol="_wide")]
        elif kernel == "rbf":
            stages, names = fourier_stages(data, task, dimensions, "_wide"), [f"_wide_{d}" for d in range(dimensions)]
        column = "_wide" if stages else FEATURES
        base = LinearSVC(featuresCol=column, labelCol=LABEL, maxIter=max_iter, regParam=1.0 / (C * row_count(data)),
                         standardization=False)
        rows = chain(stages, data)
        if task.classes <= 2 or names is None:
            return [*stages, one_per_class(base, task, column).fit(rows)]
        return [*stages, *widest_margin(base, rows.select(column, LABEL), names, task.classes)]
    return fit


def widest_margin(base: LinearSVC, rows: DataFrame, names: list[str], classes: int) -> list[Transformer]:
    """One linear machine per class; the class with the largest margin wins.

    The margins are written as a projection of the named inputs, which keeps scoring inside the JVM.
    """
    table = rows.persist()

    def margin(k: int) -> str:
        m = base.fit(table.withColumn(LABEL, (F.col(LABEL) == k).cast("double")))
        return " + ".join([sql_number(m.intercept), *[f"{sql_number(c)} * `{n}`" for c, n in zip(m.coefficients, names)]])
    with ThreadPoolExecutor(max_workers=4) as pool:
        margins = list(pool.map(margin, range(classes)))
    table.unpersist()
    return [projection(f"array({', '.join(margins)}) AS _margins"),
            projection("CAST(array_position(_margins, array_max(_margins)) - 1 AS DOUBLE) AS _prediction")]
