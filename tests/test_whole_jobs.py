"""Registered queries do the operators' whole job."""

import inspect

import pytest

from tabwright.operators import impute, select
from tabwright.operators.models import boost, classify, regress, stack
from tabwright.operators.models.search import TUNERS
from tabwright.plans import QUERIES, cleaning, models, selection, tuning

SIZES = {"trees", "depth", "max_iter", "iterations", "dimensions", "degree", "k", "max_depth"}


def recorder(calls, fn):
    def call(*args, **kwargs):
        calls.append((fn, inspect.signature(fn).bind(*args, **kwargs).arguments))
    return call


def check(calls):
    assert calls
    for fn, given in calls:
        for name, p in inspect.signature(fn).parameters.items():
            if name in SIZES and name in given:
                assert given[name] >= p.default, (fn.__name__, name)
            if name == "members":
                assert given.get(name) is None, fn.__name__


@pytest.mark.parametrize("name", sorted(TUNERS))
def test_searches_cover_the_default_space(monkeypatch, name):
    seen = {}

    class Found:
        trials = "trials"

    def search(df, task, tuner, metric=None, trials=10, k=5, space=None, **more):
        seen.update(space=space or tuner.space, trials=trials, k=k)
        return Found
    monkeypatch.setattr(tuning.search, "search", search)
    for source in ("judged_texts", "texts"):
        monkeypatch.setattr(tuning, source, lambda spark, sf: None)
    assert QUERIES[name](None, None) == "trials"
    assert seen == {"space": TUNERS[name].space, "trials": 30, "k": 5}


def test_models_have_default_sizes(monkeypatch):
    calls = []
    for module in (boost, classify, regress, stack):
        for name, fn in inspect.getmembers(module, inspect.isfunction):
            if fn.__module__ == module.__name__ and SIZES & set(inspect.signature(fn).parameters):
                monkeypatch.setattr(module, name, recorder(calls, fn))
    for _, _, make in [*models.CLASSIFIERS.values(), *models.REGRESSORS.values()]:
        make()
    assert len(calls) >= 17
    check(calls)


@pytest.mark.parametrize("module,operator,plan,query", [
    (select, "importance_rf_regression", selection, "importance_rf_regression"),
    (select, "importance_rf_classifier", selection, "importance_rf_classifier"),
    (select, "importance_gbt", selection, "importance_gbt"), (impute, "impute_random_forest", cleaning, "impute_random_forest")])
def test_forests_have_default_sizes(monkeypatch, spark, small, module, operator, plan, query):
    calls = []
    monkeypatch.setattr(module, operator, recorder(calls, getattr(module, operator)))
    QUERIES[query](spark, small)
    check(calls)


def test_neighbour_join_of_many_groups_in_rounds(spark):
    import numpy as np
    from pyspark.sql import functions as F
    from tabwright.operators import neighbors
    rng = np.random.default_rng(5)
    cells = [(i, *[float(x) if rng.random() < 0.7 else None for x in rng.normal(size=3)]) for i in range(300)]
    df = spark.createDataFrame(cells, "id long, a double, b double, c double")
    many = df.select(F.pmod("id", F.lit(7)).alias("group"), "id", F.array(F.coalesce("a", F.lit(0.0))).alias("features"))

    def results():
        return (sorted(map(tuple, neighbors.knn_join(many, many, 2, exclude_self=True).collect())),
                sorted(map(tuple, neighbors.impute_knn(df, ["a", "b", "c"], "id").collect())))
    want = results()
    spark.conf.set("tabwright.neighbors.maxPivots", "3")
    try:
        got = results()
    finally:
        spark.conf.unset("tabwright.neighbors.maxPivots")
    assert got[0] == want[0] and len(got[0]) == 600
    assert got[1] == want[1] and all(x is not None for row in got[1] for x in row)


def test_more_than_a_thousand_values(spark):
    from pyspark.sql import functions as F
    from tabwright.operators import analyze, evaluate
    t = spark.range(1_100).select(F.pmod("id", F.lit(3)).alias("x"), F.col("id").alias("y"))
    got = analyze.crosstab_counts(t.unionAll(t), "x", "y")
    assert got.columns == ["x", "y", "n"] and got.count() == 1_100 and got.where("n = 2").count() == 1_100
    matrix = evaluate.confusion_matrix(t, "x", "y")
    assert matrix.count() == 1_100 ** 2 and matrix.agg(F.sum("n")).first()[0] == 1_100
