"""Planted structure is found, and pipelines survive saving, loading and streaming."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.operators.models import boost, classify, regress, search, stack
from tabwright.operators.models.recipe import Task, train_classifier, train_regressor
from tabwright.operators.outliers import fit_iqr
from tabwright.operators.scale import fit_linear
from tabwright.sources import load_model, load_table, save_model
from tabwright.streaming import score


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 3))
    y = 3 * x[:, 0] - 2 * x[:, 1] + 1
    c = np.where(x[:, 0] + x[:, 1] > 0, "up", "down")
    ring = np.where((x[:, :2] ** 2).sum(axis=1) > 1.4, "out", "in")
    rows = [(i, *map(float, r), float(t), str(k), str(g)) for i, (r, t, k, g) in enumerate(zip(x, y, c, ring))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, y double, k string, ring string").persist()


NUMBER = Task("id", ("a", "b", "c"), "y")
SIDE = Task("id", ("a", "b", "c"), "k")
RING = Task("id", ("a", "b"), "ring")


@pytest.mark.parametrize("name,fit,floor", [
    ("linear", regress.linear(), 0.999), ("ridge", regress.ridge(), 0.99), ("lasso", regress.lasso(), 0.99),
    ("svr", regress.svr(C=10, kernel="linear", iterations=30), 0.99), ("svr_rbf", regress.svr(C=100, dimensions=80, iterations=30), 0.8),
    ("extra", regress.extra_trees(trees=5, depth=8), 0.7), ("ada", boost.adaboost_regressor(trees=6, depth=4), 0.7)])
def test_regressors(planted, name, fit, floor):
    assert train_regressor(planted, NUMBER, fit).report.first()["r2"] > floor


def accuracy(fitted):
    return fitted.report.where("label = 'accuracy'").first()["f1"]


@pytest.mark.parametrize("name,fit,task,floor", [
    ("logistic", classify.logistic(), SIDE, 0.95), ("ada", boost.adaboost_classifier(trees=8), SIDE, 0.8),
    ("svm", classify.svm(max_iter=20), SIDE, 0.95), ("rbf", classify.svm(C=10, kernel="rbf", dimensions=60, max_iter=40), RING, 0.85),
    ("stack", stack.stack_classifiers(stack.default_classifiers(5, 4), 2), SIDE, 0.85)])
def test_classifiers(planted, name, fit, task, floor):
    assert accuracy(train_classifier(planted, task, fit)) > floor


def test_multi_class_svm(planted):
    four = planted.withColumn("q", F.concat((F.col("a") > 0).cast("string"), (F.col("b") > 0).cast("string")))
    assert accuracy(train_classifier(four, Task("id", ("a", "b"), "q"), classify.svm(max_iter=20))) > 0.8


def test_multi_class_stacking(planted):
    four = planted.withColumn("q", F.concat((F.col("a") > 0).cast("string"), (F.col("b") > 0).cast("string")))
    fit = stack.stack_classifiers(stack.tuned_classifiers(5, 3, 1.0), 2)
    assert accuracy(train_classifier(four, Task("id", ("a", "b"), "q"), fit)) > 0.8


def test_ridge_matches_the_closed_form(planted):
    fitted = train_regressor(planted, Task("id", ("a", "b", "c"), "y", scaler="none", test_share=0.0), regress.ridge(50.0))
    pdf = planted.toPandas()
    x, y = pdf[["a", "b", "c"]].to_numpy(), pdf["y"].to_numpy()
    xc, yc = x - x.mean(axis=0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 50 * np.eye(3), xc.T @ yc)
    assert regress.coefficients(fitted.model)[1:] == pytest.approx(want.tolist(), rel=1e-4)


def test_saved_boosting_scores_a_stream(spark, planted, tmp_path):
    fitted = train_classifier(planted, SIDE, boost.adaboost_classifier(trees=3))
    save_model(fitted.model, str(tmp_path / "model"))
    model = load_model(str(tmp_path / "model"))
    planted.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = score.stream_parquet(spark, str(tmp_path / "in"), planted.schema)
    score.write_scored(score.batch_score(model, stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    streamed = {r["id"]: r["prediction"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {r["id"]: r["prediction"] for r in score.batch_score(model, planted).collect()}
    assert streamed == batch and len(batch) == 600


def test_fitted_transforms_on_a_stream(spark, small, tmp_path):
    events = load_table(spark, small, "events").select("event_id", "value")
    steps = [fit_iqr(events, "value"), *fit_linear(events, ["value"], "standard")]
    events.write.parquet(str(tmp_path / "in"))
    out = score.apply_fitted(score.stream_parquet(spark, str(tmp_path / "in"), events.schema), steps)
    score.write_scored(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("event_id").collect()
    assert got == score.apply_fitted(events, steps).orderBy("event_id").collect()


def test_stacked_regression_is_whole_and_survives_saving(planted, tmp_path):
    fitted = train_regressor(planted, NUMBER, stack.stack_regressors())
    assert fitted.report.first()["r2"] > 0.95
    save_model(fitted.model, str(tmp_path / "stacked"))
    again = score.batch_score(load_model(str(tmp_path / "stacked")), planted.limit(50)).select("id", "prediction")
    first = score.batch_score(fitted.model, planted.limit(50)).select("id", "prediction")
    assert again.orderBy("id").collect() == first.orderBy("id").collect()


def test_search(planted):
    found = search.search(planted, SIDE, search.TUNERS["tune_logistic"], trials=3, k=2,
                          space=search.change_space(search.TUNERS["tune_logistic"].space, {"max_iter": search.choice(20)}, ("class_weight",)))
    rows = found.trials.collect()
    assert len(rows) == 3 and found.value == max(r["value"] for r in rows) and found.model is not None
    with pytest.raises(ValueError):
        search.search(planted, NUMBER, search.TUNERS["tune_linear"], metric="accuracy", trials=1)


def test_sampler_respects_the_space():
    space = {"a": search.whole(2, 10, 2), "b": search.log_real(0.01, 1), "c": search.choice("x"), "d": search.real(0, 1, 0.25)}
    draws = search.sample_params(space, 50, 1)
    assert draws == search.sample_params(space, 50, 1)
    assert all(d["a"] in (2, 4, 6, 8, 10) and 0.01 <= d["b"] <= 1 and d["c"] == "x" and d["d"] in (0, 0.25, 0.5, 0.75, 1) for d in draws)


def test_extra_trees_and_class_forests_grow_in_few_passes(spark, monkeypatch):
    from tabwright.operators.models import cells, classify, regress, trees
    from tabwright.operators.models.recipe import Task, fit_classifier, fit_regressor

    def spark_learner(**_):
        raise AssertionError("a pass over the rows per level and tree")
    monkeypatch.setattr(regress, "DecisionTreeRegressor", spark_learner)
    monkeypatch.setattr(classify, "RandomForestClassifier", spark_learner)
    rows = spark.range(400).selectExpr("id", "double(id % 20) AS a", "double((id * 7) % 13) AS b", "double(id % 20) * 3 + 1 AS y",
                                       "if((id * 7) % 13 < 6, 'low', 'high') AS kind").repartition(3)
    model = fit_regressor(rows.select("id", "a", "b", "y"), Task("id", ("a", "b"), "y"), regress.extra_trees(trees=20, max_features=1.0))
    worst = model.transform(rows).selectExpr("max(abs(prediction - y)) AS d").first()["d"]
    assert worst < 2.0
    model = fit_classifier(rows.select("id", "a", "b", "kind"), Task("id", ("a", "b"), "kind"), classify.random_forest(trees=15, max_features="all"))
    assert model.transform(rows).where("prediction = kind").count() == 400


def test_a_tree_of_own_cuts_is_the_tree_of_its_bins(spark):
    from tabwright.operators.models import cells, trees
    rng = np.random.default_rng(2)
    x, y = np.round(rng.normal(size=(300, 2)), 1), rng.normal(size=300)
    cuts = [[(0, np.array([-0.5, 0.0, 0.7])), (1, np.array([0.1, 0.2, 0.9]))], [(1, np.array([-1.0, 0.3, 0.4]))]]
    data = spark.createDataFrame([(float(a), float(b), float(v)) for (a, b), v in zip(x, y)], "a double, b double, _label double").repartition(3)
    got = [r["_prediction"] for r in cells.cut_forest(data, ["a", "b"], cuts, 1, float(y.mean()), 1).transform(data).orderBy("a", "b").collect()]
    total = np.zeros(300)
    for cut in cuts:
        sides = [(np.searchsorted(p, x[:, i], "right") > j) for i, p in cut for j in range(len(p))]
        best = min((s for s in sides if 0 < s.sum() < 300), key=lambda s: y[s].var() * s.sum() + y[~s].var() * (~s).sum())
        total += np.where(best, y[best].mean(), y[~best].mean())
    order = np.lexsort((x[:, 1], x[:, 0]))
    assert np.allclose(got, (total / 2)[order])
    spark.conf.set("tabwright.trees.cutCells", "3")
    try:
        assert cells.cut_forest(data, ["a", "b"], cuts, 1, 0.0, 1) is None
    finally:
        spark.conf.unset("tabwright.trees.cutCells")


def test_cells_of_many_rows_grow():
    from tabwright.operators.models.trees import EXACT, Spec, grow
    bins = np.array([[0], [1], [2]], np.uint8)
    weight, label = np.array([EXACT, 2.0, 4.0]), np.array([EXACT, 6.0, 20.0])  # rows of each cell, sums of their labels
    nodes = grow(Spec("forest", depth=4), bins, 3, np.arange(3), np.zeros(3, np.int64), np.stack([weight, label, np.ones(3)], 1), np.array([0]))
    assert sorted((nodes.stats[:, 1] / nodes.stats[:, 0])[nodes.feature < 0]) == [1.0, 3.0, 5.0]
