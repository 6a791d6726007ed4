"""Hyper-parameter search: random trials from a described space, scored by cross-validation."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import cached_property, reduce

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tabwright.functions.columns import quoted
from tabwright.operators.models import boost, classify, lines, regress, stack, trees
from tabwright.operators.models.lines import Line
from tabwright.operators.models.recipe import (LABEL, PREDICTED, Fit, Task, fit_classifier, fit_regressor, folds, prepare)
from tabwright.operators.models.trees import Spec
from tabwright.operators.neighbors import knn_join, scaled_features
from tabwright.operators.stats import average_ranks
from tabwright.session import checkpointed

Space = dict[str, dict]
TRIALS = "trial int, value double, params string"
WIDEST = 512  # features whose products a task sums up
CLASS_METRICS = ("accuracy", "f1", "precision", "recall", "roc_auc")
NUMBER_METRICS = ("r2", "neg_mean_squared_error", "neg_mean_absolute_error")


def choice(*values) -> dict:
    return {"type": "categorical", "values": list(values)}


def whole(low: int, high: int, step: int = 1) -> dict:
    return {"type": "int", "low": low, "high": high, "step": step}


def real(low: float, high: float, step: float | None = None) -> dict:
    return {"type": "float", "low": low, "high": high, "step": step}


def log_real(low: float, high: float) -> dict:
    return {"type": "loguniform", "low": low, "high": high}


def change_space(space: Space, override: Mapping[str, dict] | None = None, remove: tuple[str, ...] = ()) -> Space:
    """Default space with parameters replaced, added or left out."""
    return {k: v for k, v in {**space, **(override or {})}.items() if k not in remove}


def sample_params(space: Space, trials: int, seed: int = 42) -> list[dict]:
    """``trials`` independent draws, the same for the same seed."""
    rng = np.random.default_rng(seed)

    def draw(p: dict):
        if p["type"] == "categorical":
            return p["values"][int(rng.integers(len(p["values"])))]
        if p["type"] == "int":
            step = p.get("step") or 1
            return int(p["low"] + step * rng.integers((p["high"] - p["low"]) // step + 1))
        if p["type"] == "loguniform":
            return float(np.exp(rng.uniform(np.log(p["low"]), np.log(p["high"]))))
        if p["type"] == "float":
            if p.get("step"):
                return float(p["low"] + p["step"] * rng.integers(int(round((p["high"] - p["low"]) / p["step"])) + 1))
            return float(rng.uniform(p["low"], p["high"]))
        raise ValueError(f"unknown parameter type {p['type']}")
    return [{name: draw(p) for name, p in sorted(space.items())} for _ in range(trials)]


def search_space_table(spark: SparkSession, space: Space, trials: int, seed: int = 42) -> DataFrame:
    rows = [(i, json.dumps(p, sort_keys=True)) for i, p in enumerate(sample_params(space, trials, seed))]
    return spark.createDataFrame(rows, "trial int, params string")


@dataclass(frozen=True)
class Tuner:
    """One model's default space, and how to build it from parameters.

    ``spec`` describes a tree ensemble, ``line`` a linear model; these and nearest neighbours are searched in one go, all
    trials and folds together.
    """

    space: Space
    build: Callable[..., Fit] | None
    classify: bool
    neighbours: bool = False
    spec: Callable[..., Spec] | None = None
    line: Callable[..., Line] | None = None


@dataclass
class Search:
    trials: DataFrame
    best: dict
    value: float
    refit: Callable[[], PipelineModel | trees.TreeModel] | None  # None for nearest neighbours, which keep their rows instead

    @cached_property
    def model(self) -> PipelineModel | trees.TreeModel | None:
        """The best model, fitted on all rows when first asked for."""
        return self.refit and self.refit()


def fold_scores(guesses: DataFrame, metric: str) -> DataFrame:
    """(trial, _fold, value) of rows (trial, _fold, actual, guess, lead); larger is better.

    Precision, recall and f1 are plain means over the classes seen on either side; roc_auc needs two classes, 0/1 in
    ``actual``, and ranks by ``lead``.
    """
    by = ["trial", "_fold"]
    if metric == "roc_auc":
        cells = guesses.groupBy(*by, F.col("lead").alias("value")).agg(
            F.count("*").alias("n"), F.sum(F.col("actual").cast("long")).alias("pos"))
        s = average_ranks(cells, by).groupBy(*by).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").cast("double").alias("p"),
                                                      F.sum(F.col("n") - F.col("pos")).cast("double").alias("q"))
        p, q = F.col("p"), F.col("q")
        return s.select(*by, F.try_divide(F.col("r") - p * (p + 1) / 2, p * q).alias("value"))
    if metric in NUMBER_METRICS:
        y, f = F.col("actual"), F.col("guess")
        t = guesses.groupBy(*by).agg(F.avg(F.pow(y - f, 2)).alias("mse"), F.avg(F.abs(y - f)).alias("mae"),
                                     F.var_pop(F.when(f.isNotNull(), y)).alias("v"))
        return t.select(*by, {"r2": 1 - F.try_divide("mse", "v"), "neg_mean_squared_error": -F.col("mse"),
                              "neg_mean_absolute_error": -F.col("mae")}[metric].alias("value"))
    counts = guesses.groupBy(*by, "actual", "guess").agg(F.count("*").alias("n"))
    hit = F.when(F.col("actual") == F.col("guess"), F.col("n")).otherwise(0)
    if metric == "accuracy":
        return counts.groupBy(*by).agg((F.sum(hit) / F.sum("n")).alias("value"))
    sides = counts.withColumn("hit", hit).select(*by, F.explode(F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("truth"), F.lit(0).cast("long").alias("taken"), F.col("hit").alias("hit")),
        F.struct(F.col("guess").alias("label"), F.lit(0).cast("long").alias("truth"), F.col("n").alias("taken"),
                 F.lit(0).cast("long").alias("hit")))).alias("s")).select(*by, "s.*")
    t = sides.groupBy(*by, "label").agg(F.sum("truth").alias("truth"), F.sum("taken").alias("taken"), F.sum("hit").alias("hit"))
    share = {"precision": F.try_divide("hit", "taken"), "recall": F.try_divide("hit", "truth"),
             "f1": F.try_divide(2 * F.col("hit"), F.col("taken") + F.col("truth"))}[metric]
    return t.groupBy(*by).agg(F.avg(F.coalesce(share, F.lit(0.0))).alias("value"))


def tree_guesses(split: DataFrame, task: Task, tuner: Tuner, drawn: list[dict], k: int) -> DataFrame | None:
    """(trial, _fold, actual, guess, lead) of all trials; features are binned once, all ensembles grow side by side.

    None for reweighted and stacked ensembles of a table that does not fit into a task.
    """
    classes, label = 0, task.target
    if tuner.classify:
        indexer = StringIndexer(inputCol=task.target, outputCol=LABEL, stringOrderType="alphabetAsc").fit(split)
        split, classes, label = indexer.transform(split), len(indexer.labels), LABEL
    fits = [(replace(tuner.spec(**params), classes=classes, seed=task.seed), f) for params in drawn for f in range(k)]
    if any(s.kind in ("ada", "stack") for s, _ in fits) and not trees.fits_in_tasks(
            split.sparkSession, split.count(), len(task.features), fits):
        return None  # weights and inner folds of a large table: one fit after the other
    raw = any(m.kind == "line" for s, _ in fits for m in s.members)
    table = trees.binned(split, task.key, task.features, label, trees.bin_edges(split, task.features), raw)
    found = trees.out_of_fold(table, len(task.features), fits)
    return found.select(F.floor(F.col("fit") / k).cast("int").alias("trial"), (F.col("fit") % k).alias("_fold"),
                        F.col("_y").alias("actual"), F.col("_p").alias("guess"), F.col("_s").alias("lead"))


def line_guesses(split: DataFrame, task: Task, tuner: Tuner, drawn: list[dict], k: int) -> DataFrame | None:
    """The same for linear models: one pass over the rows serves a step of all of them. None for least squares of many features."""
    classes, label = 0, task.target
    if len(task.features) > WIDEST and any(tuner.line(**params).squares for params in drawn):
        return None
    if tuner.classify:
        indexer = StringIndexer(inputCol=task.target, outputCol=LABEL, stringOrderType="alphabetAsc").fit(split)
        split, classes, label = indexer.transform(split), len(indexer.labels), LABEL
    made = [replace(tuner.line(**params), classes=classes, scaler=task.scaler, seed=task.seed) for params in drawn]
    found = lines.out_of_fold(split, task.features, label, made, k)
    return found.select(F.floor(F.col("fit") / k).cast("int").alias("trial"), "_fold", F.col("_y").alias("actual"),
                        F.col("_p").alias("guess"), F.col("_s").alias("lead"))


def tree_model(rows: DataFrame, task: Task, tuner: Tuner, params: dict) -> trees.TreeModel:
    spec, labels = replace(tuner.spec(**params), seed=task.seed), ()
    if tuner.classify:
        indexer = StringIndexer(inputCol=task.target, outputCol=LABEL, stringOrderType="alphabetAsc").fit(rows)
        rows, labels, spec = indexer.transform(rows), indexer.labels, replace(spec, classes=len(indexer.labels))
    return trees.fit_model(rows, task.key, task.features, LABEL if tuner.classify else task.target, spec, labels)


def neighbour_guesses(split: DataFrame, task: Task, tuner: Tuner, drawn: list[dict], k: int) -> DataFrame:
    """The same for nearest neighbours: one join per exponent, over all folds, with the largest number of neighbours.

    A trial reads off its own first neighbours.
    """
    settings = [{"k": 5 if tuner.classify else 3, "weights": "uniform", "p": 2, **params} for params in drawn]
    by = ["group", "query_id"]
    known = split.select(F.col("_fold").alias("group"), quoted(task.key).alias("query_id"), quoted(task.target).alias("actual"))
    donors = split.select(quoted(task.key).alias("donor_id"), quoted(task.target).alias("y"))
    exponents = sorted({s["p"] for s in settings})
    for p in exponents:
        sides = {"queries": None, "donors": None}
        for f in range(k):
            train = split.where(F.col("_fold") != f)
            features = scaled_features(train, list(task.features), task.scaler)
            for name, rows in (("queries", split.where(F.col("_fold") == f)), ("donors", train)):
                part = rows.select(F.lit(f).alias("group"), quoted(task.key).alias("id"), features.alias("features"))
                sides[name] = part if sides[name] is None else sides[name].unionByName(part)
        most = max(s["k"] for s in settings if s["p"] == p)
        near = knn_join(sides["queries"], sides["donors"], most, p=p).join(donors, "donor_id")
        known = known.join(near.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", "distance", "y"))).alias(f"_near{p}")),
                           by, "left")  # ``most`` neighbours each
    table = split.sparkSession.createDataFrame([(i, s["k"], s["weights"], s["p"]) for i, s in enumerate(settings)],
                                               "trial int, k int, weights string, p int")  # one row per trial
    # a row's neighbours stay together: its guess in a trial follows from them, with no row per trial and neighbour
    near = F.coalesce(*[F.when(F.col("p") == p, F.col(f"_near{p}")) for p in exponents])
    taken = F.filter(near, lambda x: x["rank"] <= F.col("k"))
    exact = F.exists(taken, lambda x: x["distance"] == 0)

    def weight(x):
        close = F.when(exact, (x["distance"] == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), x["distance"]))
        return F.when(F.col("weights") == "uniform", F.lit(1.0)).otherwise(close)
    rows = known.crossJoin(F.broadcast(table)).withColumn("_taken", taken).withColumn(
        "_taken", F.transform("_taken", lambda x: F.struct(weight(x).alias("w"), x["y"].alias("y"))))

    def total(of, value=lambda x: x["w"]):
        return F.aggregate(of, F.lit(0.0), lambda s, x: s + value(x))
    if tuner.classify:
        labels = F.array_distinct(F.transform("_taken", lambda x: x["y"]))
        votes = F.transform(labels, lambda y: F.struct(
            (-F.round(total(F.filter("_taken", lambda x: x["y"] == y)), 9)).alias("s"), y.alias("y")))
        guess = F.array_min(votes)["y"]
    else:
        guess = F.try_divide(total(F.col("_taken"), lambda x: x["w"] * x["y"]), total(F.col("_taken")))
    return rows.select("trial", F.col("group").alias("_fold"), "actual", guess.alias("guess"), F.lit(None).cast("double").alias("lead"))


def search(df: DataFrame, task: Task, tuner: Tuner, metric: str | None = None, trials: int = 10, k: int = 5,
           space: Space | None = None, seed: int = 42, parallelism: int = 4) -> Search:
    """Trial table, best parameters, and the best model refitted on all rows. Larger values are always better.

    A trial's value is the mean over the folds that have rows. Tree ensembles and nearest neighbours share their work
    between all trials. Trials of other models run next to each other from driver threads; equal draws are fitted once.
    """
    metric = metric or ("accuracy" if tuner.classify else "r2")
    allowed = CLASS_METRICS if tuner.classify else NUMBER_METRICS
    if metric not in allowed or metric == "roc_auc" and not (tuner.spec or tuner.line):
        raise ValueError(f"metric {metric} does not fit the model; choose from {', '.join(allowed)}")
    rows = prepare(df, task, tuner.classify)
    split = folds(rows, task, k).persist()
    drawn = sample_params(space or tuner.space, trials, seed)
    names = [json.dumps(p, sort_keys=True) for p in drawn]
    distinct = {n: p for n, p in zip(names, drawn)}
    together = tree_guesses if tuner.spec else line_guesses if tuner.line else neighbour_guesses if tuner.neighbours else None
    guesses = together(split, task, tuner, list(distinct.values()), k) if together else None
    if guesses is None:
        guesses = _fitted_guesses(split, task, tuner, list(distinct.values()), k, parallelism)
    means = {r["trial"]: r["value"] for r in fold_scores(guesses, metric).groupBy("trial").agg(
        F.avg("value").alias("value")).collect()}  # one row per trial
    by_name = {n: means.get(i) for i, n in enumerate(distinct)}
    values = [by_name[n] for n in names]
    split.unpersist()
    table = df.sparkSession.createDataFrame([(i, v, n) for i, (v, n) in enumerate(zip(values, names))], TRIALS)
    at = int(np.nanargmax(np.array(values, dtype=float)))
    fit = None
    if not tuner.neighbours:
        def fit():
            if tuner.spec and tuner.spec(**drawn[at]).kind != "stack":
                return tree_model(rows, task, tuner, drawn[at])
            return (fit_classifier if tuner.classify else fit_regressor)(rows, task, tuner.build(**drawn[at]))
    return Search(table, drawn[at], values[at], fit)


def _fitted_guesses(split: DataFrame, task: Task, tuner: Tuner, drawn: list[dict], k: int, parallelism: int) -> DataFrame:
    """(trial, _fold, actual, guess, lead) by one fit per trial and fold."""
    fit = fit_classifier if tuner.classify else fit_regressor

    def run(job: tuple[int, int]) -> DataFrame | None:
        trial, f = job
        train, rest = split.where(F.col("_fold") != f).drop("_fold"), split.where(F.col("_fold") == f).drop("_fold")
        if rest.isEmpty():
            return None
        guess = fit(train, task, tuner.build(**drawn[trial])).transform(rest)
        return checkpointed(guess.select(F.lit(trial).alias("trial"), F.lit(f).alias("_fold"), quoted(task.target).alias("actual"),
                                         quoted(PREDICTED).alias("guess"), F.lit(None).cast("double").alias("lead")))
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        parts = [p for p in pool.map(run, [(i, f) for i in range(len(drawn)) for f in range(k)]) if p is not None]
    return reduce(DataFrame.unionByName, parts)


TREES = whole(50, 300)
CLASS_WEIGHT = choice(None, "balanced")
FEATURE_SHARE = choice("sqrt", "log2", "all")


def _forest(trees, depth, min_split, min_leaf, max_features) -> Spec:
    return Spec("forest", trees=trees, depth=depth, min_split=min_split, min_leaf=min_leaf, features=max_features, rows="bootstrap")


def _class_forest(class_weight, **more) -> Spec:
    return replace(_forest(**more), impurity="gini", balanced=class_weight == "balanced")


# Friedman's improvement, n1 n2 / (n1 + n2) (m1 - m2) ** 2 for sides of n1, n2 rows and means m1, m2, is what a split takes off the
# sum of squared errors: the two names stand for the same trees.
CRITERIA = {"squared_error": "variance", "friedman_mse": "variance", "absolute_error": "absolute", "poisson": "poisson"}


def _tree(depth, min_split, min_leaf, max_features, criterion="squared_error") -> Spec:
    return Spec("forest", trees=1, depth=depth, min_split=min_split, min_leaf=min_leaf, features=max_features, impurity=CRITERIA[criterion])


def _class_tree(impurity, class_weight, **more) -> Spec:
    return replace(_tree(**more), impurity=impurity, balanced=class_weight == "balanced")


def _boosted(trees, rate, depth, min_split, min_leaf, subsample, max_features="all") -> Spec:
    return Spec("boost", trees=trees, rate=rate, depth=depth, min_split=min_split, min_leaf=min_leaf, rows=subsample,
                features=max_features)


TUNERS: dict[str, Tuner] = {
    "tune_linear": Tuner({"intercept": choice(True, False)}, regress.linear, False,
                         line=lambda intercept=True: Line(squares=True, intercept=intercept)),
    "tune_rf_regression": Tuner({"trees": TREES, "depth": whole(5, 30), "min_split": whole(2, 10), "min_leaf": whole(1, 10),
                                 "max_features": FEATURE_SHARE}, regress.random_forest, False, spec=_forest),
    "tune_rf_classifier": Tuner({"trees": TREES, "depth": whole(5, 30), "min_split": whole(2, 10), "min_leaf": whole(1, 10),
                                 "max_features": FEATURE_SHARE, "class_weight": CLASS_WEIGHT}, classify.random_forest, True,
                                spec=_class_forest),
    "tune_gbt_classifier": Tuner({"trees": TREES, "rate": log_real(0.01, 0.3), "depth": whole(3, 20), "min_split": whole(2, 10),
                                  "min_leaf": whole(1, 10), "subsample": real(0.6, 1.0)}, classify.gradient_boosting, True,
                                 spec=_boosted),
    "tune_logistic": Tuner({"C": log_real(0.01, 10), "penalty": choice("l1", "l2", "elasticnet", "none"),
                            "l1_ratio": real(0, 1), "max_iter": whole(100, 1000), "class_weight": CLASS_WEIGHT},
                           classify.logistic, True,
                           line=lambda C=1.0, penalty="l2", l1_ratio=0.5, max_iter=100, class_weight=None: Line(
                               C=C, penalty=penalty, l1_ratio=l1_ratio, max_iter=max_iter, balanced=class_weight == "balanced")),
    "tune_dt_classifier": Tuner({"depth": whole(3, 30), "min_split": whole(2, 20), "min_leaf": whole(1, 20),
                                 "max_features": FEATURE_SHARE, "impurity": choice("gini", "entropy"), "class_weight": CLASS_WEIGHT},
                                classify.decision_tree, True, spec=_class_tree),
    "tune_adaboost_classifier": Tuner({"trees": whole(50, 500), "rate": log_real(0.01, 2)}, boost.adaboost_classifier, True,
                                      spec=lambda trees, rate: Spec("ada", trees=trees, rate=rate, depth=1, impurity="gini")),
    "tune_knn_classifier": Tuner({"k": whole(1, 30), "weights": choice("uniform", "distance"), "p": whole(1, 2)}, None, True, True),
    "tune_stacking_classifier": Tuner(
        {"forest": whole(50, 200), "depth": whole(3, 20), "boosted": whole(50, 200), "rate": log_real(0.01, 0.3), "C": log_real(0.01, 10),
         "final": choice("logistic", "forest")},
        lambda forest, depth, boosted, rate, C, final, k=5: stack.stack_classifiers(
            stack.tuned_classifiers(forest, boosted, C, depth, rate), k, 1.0, final), True,
        spec=lambda forest, depth, boosted, rate, C, final: Spec("stack", members=(
            Spec("forest", trees=forest, depth=depth, features="sqrt", rows="bootstrap", impurity="gini"),
            Spec("boost", trees=boosted, rate=rate, depth=3), Spec("line", C=C)), final=final)),
    "tune_dt_regressor": Tuner({"depth": whole(3, 30), "min_split": whole(2, 20), "min_leaf": whole(1, 20),
                                "max_features": FEATURE_SHARE, "criterion": choice(*CRITERIA)}, regress.decision_tree, False, spec=_tree),
    "tune_knn_regressor": Tuner({"k": whole(1, 30), "weights": choice("uniform", "distance"), "p": whole(1, 2)}, None, False, True),
    "tune_gbt_regressor": Tuner({"trees": whole(50, 500), "rate": log_real(0.01, 0.3), "depth": whole(3, 20), "min_split": whole(2, 20),
                                 "min_leaf": whole(1, 10), "subsample": real(0.6, 1.0), "max_features": FEATURE_SHARE},
                                regress.gradient_boosting, False, spec=_boosted),
    "tune_adaboost_regressor": Tuner({"trees": whole(50, 500), "rate": log_real(0.01, 2),
                                      "loss": choice("linear", "square", "exponential")}, boost.adaboost_regressor, False,
                                     spec=lambda trees, rate, loss: Spec("ada", trees=trees, rate=rate, depth=3, loss=loss)),
    "tune_extra_trees": Tuner({"trees": whole(50, 500), "depth": whole(5, 30), "min_split": whole(2, 20), "min_leaf": whole(1, 10),
                               "max_features": FEATURE_SHARE, "bootstrap": choice(True, False)}, regress.extra_trees, False,
                              spec=lambda bootstrap, **more: replace(_forest(**more), rows="bootstrap" if bootstrap else "all",
                                                                     random_cuts=True)),
    "tune_svr": Tuner({"C": log_real(0.01, 100), "epsilon": log_real(0.001, 1), "kernel": choice("linear", "poly", "rbf"),
                       "gamma": choice("scale", "auto")}, regress.svr, False,
                      line=lambda C=1.0, epsilon=0.1, kernel="rbf", gamma="scale": Line(
                          C=C, epsilon=epsilon, kernel=kernel, gamma=gamma, max_iter=60)),
    "tune_xgb_regressor": Tuner({"trees": whole(50, 500), "rate": log_real(0.01, 0.3), "depth": whole(3, 15),
                                 "min_child": whole(1, 10), "subsample": real(0.5, 1.0), "colsample": real(0.5, 1.0), "gamma": real(0, 5),
                                 "l1": log_real(0.001, 10), "l2": log_real(0.001, 10)}, regress.boosted_trees, False,
                                spec=lambda trees, rate, depth, min_child, subsample, colsample, gamma, l1, l2: Spec(
                                    "boost", trees=trees, rate=rate, depth=depth, impurity="second", min_child=min_child,
                                    rows=subsample, tree_features=colsample, gamma=gamma, l1=l1, l2=l2)),
    "tune_stacking_regressor": Tuner(
        {"forest": whole(50, 200), "depth": whole(3, 20), "boosted": whole(50, 200), "rate": log_real(0.01, 0.3), "extra": whole(50, 200),
         "extra_rate": log_real(0.01, 0.3), "final": choice("linear", "forest")},
        lambda forest, depth, boosted, rate, extra, extra_rate, final, k=5: stack.stack_regressors(
            stack.default_regressors(forest, boosted, extra, depth, rate, extra_rate), k, final=final), False,
        spec=lambda forest, depth, boosted, rate, extra, extra_rate, final: Spec("stack", members=(
            Spec("forest", trees=forest, depth=depth, rows="bootstrap"), Spec("boost", trees=boosted, rate=rate, depth=3),
            Spec("boost", trees=extra, rate=extra_rate, depth=6, impurity="second", l2=1.0, min_child=1.0)), final=final)),
}


def best_trial(trials: DataFrame) -> DataFrame:
    return trials.where(F.col("value").isNotNull()).orderBy(F.desc("value"), "trial").limit(1)


def ranked_trials(trials: DataFrame) -> DataFrame:
    return trials.orderBy(F.desc_nulls_last("value"), "trial")


def optimization_history(trials: DataFrame) -> DataFrame:
    """(trial, value, best_so_far)."""
    so_far = Window.orderBy("trial").rangeBetween(Window.unboundedPreceding, Window.currentRow)  # one row per trial
    return trials.select("trial", "value", F.max("value").over(so_far).alias("best_so_far"))


def parallel_coordinates(trials: DataFrame) -> DataFrame:
    """(trial, value, parameter, setting): one row per trial and parameter."""
    return trials.select("trial", "value", F.explode(F.from_json("params", "map<string,string>")).alias("parameter", "setting"))


def _encoded(trials: DataFrame) -> tuple[DataFrame, list[str]]:
    """Settings as numbers, text settings by their rank, one column per parameter."""
    long = parallel_coordinates(trials)
    names = sorted(r[0] for r in long.select("parameter").distinct().collect())
    wide = long.groupBy("trial", "value").pivot("parameter", names).agg(F.first("setting"))
    for n in names:
        if wide.where(quoted(n).try_cast("double").isNull()).isEmpty():
            wide = wide.withColumn(n, quoted(n).try_cast("double"))
        else:
            filled = wide.withColumn(n, F.coalesce(quoted(n), F.lit("none")))
            wide = StringIndexer(inputCol=n, outputCol=f"_{n}", stringOrderType="alphabetAsc").fit(filled).transform(
                filled).drop(n).withColumnRenamed(f"_{n}", n)
    return wide, names


def param_importance(trials: DataFrame, seed: int = 0) -> DataFrame:
    """(parameter, importance): how much of the value's variation a forest ascribes to each parameter."""
    wide, names = _encoded(trials)
    data = VectorAssembler(inputCols=names, outputCol="_x").transform(wide.where(F.col("value").isNotNull()))
    model = RandomForestRegressor(featuresCol="_x", labelCol="value", numTrees=50, seed=seed).fit(data)
    rows = [(n, float(v)) for n, v in zip(names, model.featureImportances.toArray())]
    return trials.sparkSession.createDataFrame(rows, "parameter string, importance double")


def contour_table(trials: DataFrame) -> DataFrame:
    """(trial, value, x, y, x_name, y_name) for the two most important parameters."""
    two = [r["parameter"] for r in param_importance(trials).orderBy(F.desc("importance"), "parameter").limit(2).collect()]
    if len(two) < 2:
        raise ValueError("needs two parameters")
    settings = F.from_json("params", "map<string,string>")
    return trials.select("trial", "value", settings[two[0]].alias("x"), settings[two[1]].alias("y"),
                         F.lit(two[0]).alias("x_name"), F.lit(two[1]).alias("y_name"))

