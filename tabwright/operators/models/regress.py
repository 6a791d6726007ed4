"""Regressors. Each function returns the fitting step of one model."""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.ml import Transformer
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from tabwright.operators.models import cells
from tabwright.operators.models.classify import MAX_TREE_DEPTH, direct
from tabwright.operators.models.kernels import fourier_stages
from tabwright.operators.models.recipe import FEATURES, LABEL, Fit, Task, projection, scaled_names, sql_number
from tabwright.operators.stats import aggregate_once

COLUMNS = {"featuresCol": FEATURES, "labelCol": LABEL, "predictionCol": "_prediction"}


def linear(intercept: bool = True) -> Fit:
    return direct(lambda rows, task: LinearRegression(**COLUMNS, solver="normal", regParam=0.0, fitIntercept=intercept))


def coefficients(model) -> list[float]:
    """Intercept and coefficients, on the scaled features, of a fitted linear pipeline."""
    line = next(s for s in model.stages if hasattr(s, "coefficients"))
    return [float(line.intercept), *[float(c) for c in line.coefficients]]


def ridge(alpha: float = 1.0) -> Fit:
    """Penalty ``alpha`` on the summed squares. The solver divides by n and scales by the label's deviation."""
    def make(rows: DataFrame, task: Task) -> LinearRegression:
        s = aggregate_once(rows, {"n": F.count(F.lit(1)), "d": F.stddev_pop(LABEL)})
        return LinearRegression(**COLUMNS, solver="normal", elasticNetParam=0.0, standardization=False,
                                regParam=alpha * s["d"] / s["n"])
    return direct(make)


def lasso(alpha: float = 0.001) -> Fit:
    return direct(lambda rows, task: LinearRegression(**COLUMNS, elasticNetParam=1.0, regParam=alpha,
                                                      standardization=False))


def decision_tree(depth: int = 8, min_split: int = 2, min_leaf: int = 1) -> Fit:
    return direct(lambda rows, task: DecisionTreeRegressor(
        **COLUMNS, maxDepth=min(depth, MAX_TREE_DEPTH), minInstancesPerNode=max(min_leaf, min_split // 2), seed=task.seed))


def random_forest(trees: int = 100, depth: int = 15, max_features: str = "0.75", samples: float = 0.5, seed: int = 3,
                  min_leaf: int = 1) -> Fit:
    """Each row counts a Poisson number of times in a tree, ``samples`` on average; one pass where few cells of bins occur."""
    plain = direct(lambda rows, task: RandomForestRegressor(
        **COLUMNS, numTrees=trees, maxDepth=min(depth, MAX_TREE_DEPTH), featureSubsetStrategy=max_features,
        subsamplingRate=samples, minInstancesPerNode=min_leaf, seed=seed))

    def fit(data: DataFrame, task: Task) -> list[Transformer]:
        bins = cells.bins_of(data, task) if min_leaf <= 1 and trees > 1 else None
        stage = bins and cells.forest(data, task, bins, trees, min(depth, MAX_TREE_DEPTH), max_features, samples, seed)
        return [stage] if stage else plain(data, task)
    return fit


def gradient_boosting(trees: int = 100, rate: float = 0.1, depth: int = 3, max_features: str = "0.75",
                      subsample: float = 1.0, min_leaf: int = 1) -> Fit:
    """Rows in the same bins are merged first, unless rows are drawn or counted: their gradients add up."""
    def learner(**columns) -> GBTRegressor:
        return GBTRegressor(**columns, maxIter=trees, stepSize=rate, maxDepth=depth, featureSubsetStrategy=max_features,
                            subsamplingRate=subsample, minInstancesPerNode=min_leaf)

    def fit(data: DataFrame, task: Task) -> list[Transformer]:
        bins = cells.bins_of(data, task) if min_leaf <= 1 and subsample >= 1 else None
        if bins is None:
            return [learner(**COLUMNS).setSeed(task.seed).fit(data)]
        stages, rows = cells.merged(data, bins)
        return [*stages, learner(**{**COLUMNS, "featuresCol": "_bins"}, weightCol="_weight").setSeed(task.seed).fit(rows)]
    return fit


def boosted_trees(trees: int = 100, depth: int = 3, rate: float = 0.1, subsample: float = 1.0, colsample: str = "all",
                  min_child: int = 1) -> Fit:
    """The knobs of a boosted-tree library that the built-in learner has."""
    return gradient_boosting(trees, rate, depth, colsample, subsample, min_child)


def extra_trees(trees: int = 100, depth: int = 15, max_features: float = 0.75, cuts: int = 32, min_leaf: int = 1) -> Fit:
    """Trees that split at random places: each sees the features cut at its own random thresholds.

    Rows between the same thresholds count as one; one pass sums them up for all trees.
    """
    def fit(data: DataFrame, task: Task) -> list[Transformer]:
        names = scaled_names(task)
        edge = aggregate_once(data, {"mean": F.avg(LABEL), **{f"{k}{i}": fn(F.col(f"`{n}`")) for i, n in enumerate(names)
                                                              for k, fn in (("a", F.min), ("b", F.max))}})
        rng = np.random.default_rng(task.seed)
        drawn = []
        for _ in range(trees):
            used = sorted(rng.choice(len(names), size=max(1, round(max_features * len(names))), replace=False))
            drawn.append([(int(i), np.sort(rng.uniform(edge[f"a{i}"], edge[f"b{i}"], size=cuts))) for i in used])
        stage = cells.cut_forest(data, names, drawn, min(depth, MAX_TREE_DEPTH), edge["mean"], task.seed) if min_leaf <= 1 else None
        if stage:
            return [stage]
        stages: list[Transformer] = []
        rows = data
        for t in range(trees):
            used, parts = [i for i, _ in drawn[t]], []
            for i, places in drawn[t]:
                bounds = ", ".join(sql_number(x) for x in places)
                parts.append(f"CAST(size(filter(array({bounds}), c -> c <= `{names[i]}`)) AS DOUBLE) AS _cut_{t}_{i}")
            inputs = [f"_cut_{t}_{i}" for i in used]
            prepared = [SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__"),
                        VectorAssembler(inputCols=inputs, outputCol=f"_cuts_{t}")]
            for s in prepared:
                rows = s.transform(rows)
            tree = DecisionTreeRegressor(featuresCol=f"_cuts_{t}", labelCol=LABEL, predictionCol=f"_tree_{t}",
                                         maxDepth=min(depth, MAX_TREE_DEPTH), maxBins=cuts + 2,
                                         minInstancesPerNode=min_leaf, seed=task.seed + t).fit(rows)
            rows = rows.drop(*inputs, f"_cuts_{t}")
            stages += [*prepared, tree]
        mean = " + ".join(f"_tree_{t}" for t in range(trees))
        return [*stages, projection(f"({mean}) / {trees} AS _prediction")]
    return fit


def svr(C: float = 1000.0, epsilon: float = 0.1, kernel: str = "rbf", dimensions: int = 100, iterations: int = 60,
        gamma: float | None = None) -> Fit:
    """Epsilon-insensitive regression: half the squared weights plus C times the excess errors.

    The loss is smoothed near its corners and minimised by L-BFGS; each step is
    one pass in which every task sums its gradient, D + 1 numbers.
    """
    if kernel not in ("linear", "rbf"):
        raise ValueError(f"kernel {kernel} is not offered")

    def fit(data: DataFrame, task: Task) -> list[Transformer]:
        stages = fourier_stages(data, task, dimensions, "_wide", gamma) if kernel == "rbf" else []
        names = [f"_wide_{d}" for d in range(dimensions)] if stages else scaled_names(task)
        rows = data
        for s in stages:
            rows = s.transform(rows)
        column = "_wide" if stages else FEATURES
        table = rows.select(vector_to_array(column).alias("x"), F.col(LABEL).alias("y")).persist()
        s = aggregate_once(table, {"m": F.avg("y"), "d": F.stddev_pop("y"), "n": F.count("y")})
        width, mean, spread = len(names), s["m"], s["d"] or 1.0
        smooth = 0.05  # in units of the label's deviation
        eps, scale = epsilon / spread, C * s["n"] / spread  # weights are in units of the label's deviation

        def evaluate(w: np.ndarray) -> tuple[float, np.ndarray]:
            def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                total = np.zeros(width + 2)
                for pdf in batches:
                    if len(pdf):
                        x = np.column_stack([np.stack(pdf["x"].to_numpy()), np.ones(len(pdf))])
                        r = x @ w - (pdf["y"].to_numpy() - mean) / spread
                        over = np.maximum(np.abs(r) - eps, 0)
                        small = over < smooth
                        total[0] += np.where(small, over ** 2 / (2 * smooth), over - smooth / 2).sum()
                        total[1:] += (np.sign(r) * np.where(small, over / smooth, 1.0)) @ x
                yield pd.DataFrame({"at": np.arange(len(total)), "v": total})
            sums = np.zeros(width + 2)
            for r in table.mapInPandas(part, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
                sums[r["at"]] = r["v"]
            free = np.append(w[:-1], 0.0)  # the intercept carries no penalty
            return 0.5 * free @ free / scale + sums[0] / s["n"], free / scale + sums[1:] / s["n"]

        w = minimise(evaluate, np.zeros(width + 1), iterations)
        table.unpersist()
        terms = " + ".join(f"{sql_number(w[i] * spread)} * `{n}`" for i, n in enumerate(names))
        return [*stages, projection(f"{sql_number(w[-1] * spread + mean)} + {terms} AS _prediction")]
    return fit


def minimise(evaluate, start: np.ndarray, iterations: int, memory: int = 8, tolerance: float = 1e-5) -> np.ndarray:
    """L-BFGS with step halving on a handful of parameters; ``evaluate`` is the distributed part."""
    x = start
    f, g = evaluate(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    calls = 1
    while calls < iterations and sqrt(float(g @ g)) > tolerance:
        q, alphas = g.copy(), []
        for s, y in reversed(steps):
            a = (s @ q) / (y @ s)
            alphas.append(a)
            q -= a * y
        if steps:
            s, y = steps[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(alphas)):
            q += s * (a - (y @ q) / (y @ s))
        step = 1.0 if steps else 1.0 / max(1.0, sqrt(float(g @ g)))
        while calls < iterations:
            candidate = x - step * q
            f_new, g_new = evaluate(candidate)
            calls += 1
            if f_new <= f - 1e-4 * step * float(g @ q):
                break
            step /= 2
        else:
            break
        if (g_new - g) @ (candidate - x) > 1e-12:
            steps = [*steps, (candidate - x, g_new - g)][-memory:]
        done = abs(f - f_new) <= tolerance * 1e-2 * max(1.0, abs(f))
        x, f, g = candidate, f_new, g_new
        if done:
            break
    return x

