"""Split criteria of regression trees against a grower that tries every cut, and the search over them."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.operators.models import search, trees
from tabwright.operators.models.recipe import Task
from tabwright.operators.models.trees import Data, Spec, fit_predict


def cost(name, y):
    if name == "absolute_error":
        return np.abs(y - np.median(y)).sum()
    if name == "poisson":
        return 2 * (y * np.log(np.where(y > 0, y, 1.0) / max(y.mean(), 1e-300)) - y + y.mean()).sum()
    return ((y - y.mean()) ** 2).sum()


def gain_of(name, y, left):
    a, b = y[left], y[~left]
    if name == "friedman_mse":
        return len(a) * len(b) / len(y) * (a.mean() - b.mean()) ** 2
    return cost(name, y) - cost(name, a) - cost(name, b)


def brute(name, bins, y, rows, spec, depth=0):
    """Predictions of the rows by the best cut of each node."""
    out = np.full(len(rows), np.median(y[rows]) if name == "absolute_error" else y[rows].mean())
    best = 1e-9, None
    if depth < spec.depth and len(rows) >= spec.min_split:
        for f in range(bins.shape[1]):
            for c in sorted(set(bins[rows, f]))[:-1]:
                left = bins[rows, f] <= c
                if min(left.sum(), (~left).sum()) < spec.min_leaf or name == "poisson" and min(y[rows][left].sum(), y[rows][~left].sum()) <= 0:
                    continue
                gain = gain_of(name, y[rows], left)
                if gain > best[0] * (1 + 1e-9):
                    best = gain, left
    if best[1] is not None:
        for side in (best[1], ~best[1]):
            out[side] = brute(name, bins, y, rows[side], spec, depth + 1)
    return out


def counts(n=300, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (n, 3)).astype(np.uint8)
    return x, rng.poisson(np.exp(x[:, 0] / 5)) * (x[:, 1] > 2) + rng.integers(0, 2, n) * 0.37


@pytest.mark.parametrize("criterion", list(search.CRITERIA))
@pytest.mark.parametrize("depth,min_split,min_leaf", [(1, 2, 1), (4, 7, 3), (12, 2, 1)])
def test_trees_equal_brute_force(criterion, depth, min_split, min_leaf, monkeypatch):
    monkeypatch.setattr(trees, "ROWS_AT_ONCE", 50)
    x, y = counts()
    spec = search._tree(depth, min_split, min_leaf, "all", criterion)
    centre = y.mean()
    spec = trees.replace(spec, shift=centre) if criterion == "poisson" else spec
    data, rows = Data(x, 12, y - centre, np.arange(len(y)), np.zeros(len(y))), np.arange(len(y))
    found = fit_predict(spec, data, rows, rows)[:, 0] + centre
    assert np.allclose(found, brute(criterion, x, y, rows, spec))


def test_the_search_tries_all_criteria(spark):
    tuner = search.TUNERS["tune_dt_regressor"]
    assert set(tuner.space["criterion"]["values"]) == {"squared_error", "friedman_mse", "absolute_error", "poisson"}
    x, y = counts()
    table = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, y double")
    task, names = Task("id", ("a", "b", "c"), "y"), {}
    for name in search.CRITERIA:
        space = search.change_space({k: search.choice(v) for k, v in {"depth": 4, "min_split": 7, "min_leaf": 3, "max_features": "all"}.items()},
                                    {"criterion": search.choice(name)})
        found = search.search(table, task, tuner, trials=1, k=3, space=space)
        assert json.loads(found.trials.first()["params"])["criterion"] == name
        names[name] = found.value
        model = [r["prediction"] for r in found.model.transform(table).orderBy("id").collect()]
        assert np.allclose(model, brute(name, x, y, np.arange(len(y)), search._tree(4, 7, 3, "all")))
    assert names["squared_error"] == pytest.approx(names["friedman_mse"]) and len({round(v, 9) for v in names.values()}) == 3


def test_large_tables_give_the_same(spark):
    x, y = counts(400, 5)
    table = trees.binned(spark.createDataFrame([(i, i % 3, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))],
                                               "id long, _fold int, a double, b double, c double, y double").repartition(3),
                         "id", ["a", "b", "c"], "y", [[v + 0.5 for v in range(11)]] * 3)
    fits = [(search._tree(5, 4, 2, "all", c), f) for c in search.CRITERIA for f in range(3)]

    def found():
        return {(r["fit"], r["_row"]): r["_p"] for r in trees.out_of_fold(table, 3, fits).collect()}
    small = found()
    spark.conf.set("tabwright.trees.localCells", "100")
    try:
        large = found()
        spark.conf.set("tabwright.trees.medianCells", "100")
        with pytest.raises(ValueError, match="medianCells"):
            trees.out_of_fold(table, 3, fits)
    finally:
        spark.conf.unset("tabwright.trees.localCells")
        spark.conf.unset("tabwright.trees.medianCells")
    assert len(small) == 400 * 4 and small.keys() == large.keys()
    assert all(v == pytest.approx(large[k]) for k, v in small.items())


def test_poisson_needs_labels_of_at_least_zero(spark):
    x, y = counts()
    rows = [(i, *map(float, r), float(t) - 1) for i, (r, t) in enumerate(zip(x, y))]
    table = spark.createDataFrame(rows, "id long, a double, b double, c double, y double")
    space = {k: search.choice(v) for k, v in {"depth": 3, "min_split": 2, "min_leaf": 1, "max_features": "all"}.items()}
    found = search.search(table, Task("id", ("a", "b", "c"), "y"), search.TUNERS["tune_dt_regressor"], trials=8, k=2,
                          space={**space, "criterion": search.choice("poisson", "absolute_error")})
    values = {json.loads(r["params"])["criterion"]: r["value"] for r in found.trials.collect()}
    assert values["poisson"] is None and values["absolute_error"] is not None and found.best["criterion"] == "absolute_error"
