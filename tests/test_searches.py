"""Searches that share their work give what separate fits give."""

import dataclasses
import json

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabwright.operators.evaluate import classification_report, r2_mae
from tabwright.operators.models import lines, search, trees
from tabwright.operators.models.lines import Job, Line
from tabwright.operators.models.recipe import Task, folds, prepare
from tabwright.operators.neighbors import knn_classify, knn_regress

SIDE, NUMBER = Task("id", ("a", "b", "c"), "k"), Task("id", ("a", "b", "c"), "y")


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 3))
    y = 2 * x[:, 0] - x[:, 1] ** 2 + 0.4 * rng.normal(size=240)
    k = np.digitize(x[:, 0] + 0.6 * rng.normal(size=240), [-0.4, 0.6])
    rows = [(i, *map(float, r), float(t), "macro avg" if c == 2 else f"c{c}", int(c > 0)) for i, (r, t, c) in enumerate(zip(x, y, k))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double, k string, two int").persist()


def small_space(name, **more):
    return search.change_space(search.TUNERS[name].space, more)


@pytest.mark.parametrize("name,task,metric", [("tune_knn_classifier", SIDE, "f1"), ("tune_knn_regressor", NUMBER, "neg_mean_absolute_error")])
def test_neighbour_trials_equal_separate_runs(table, name, task, metric):
    found = search.search(table, task, search.TUNERS[name], metric, trials=3, k=2, space=small_space(name, k=search.whole(1, 9)))
    split = folds(prepare(table, task, name.endswith("classifier")), task, 2)
    for r in found.trials.collect():
        values = []
        for f in range(2):
            train, rest = split.where(F.col("_fold") != f), split.where(F.col("_fold") == f)
            fn = knn_classify if task is SIDE else knn_regress
            guess = fn(train, rest, "id", list(task.features), task.target, **json.loads(r["params"]))
            if task is SIDE:
                rows = classification_report(guess, "k", "prediction").collect()
                values.append(next(x["f1"] for x in reversed(rows) if x["label"] == "macro avg" and x["support"] == rest.count()))
            else:
                values.append(-r2_mae(guess, "y", "prediction").first()["mae"])
        assert abs(np.mean(values) - r["value"]) < 1e-9
    assert found.model is None


def test_tree_trials_equal_separate_fits(table):
    task = Task("id", ("a", "b", "c"), "two")
    space = small_space("tune_rf_classifier", trees=search.whole(3, 6), depth=search.whole(2, 5))
    found = search.search(table, task, search.TUNERS["tune_rf_classifier"], "accuracy", trials=3, k=3, space=space)
    again = search.search(table, task, search.TUNERS["tune_rf_classifier"], "accuracy", trials=3, k=3, space=space)
    assert found.trials.collect() == again.trials.collect()
    model = found.model
    assert isinstance(model, trees.TreeModel) and model.spec.trees == found.best["trees"] and model.spec.min_split == found.best["min_split"]
    scored = model.transform(table.withColumn("a", F.when(F.col("id") != 7, F.col("a"))))
    got = scored.select("id", "two", "prediction").collect()
    assert next(r["prediction"] for r in got if r["id"] == 7) is None
    assert np.mean([str(r["two"]) == r["prediction"] for r in got]) > 0.75


def test_equal_draws_are_fitted_once(table, monkeypatch):
    seen = []
    fit = search.fit_regressor
    monkeypatch.setattr(search, "fit_regressor", lambda *a: seen.append(1) or fit(*a))
    found = search.search(table, NUMBER, search.TUNERS["tune_linear"], trials=12, k=2)
    assert found.trials.count() == 12 and len(seen) <= 4


def odd_rows(spark, n=600):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, 3)) * [1.0, 50.0, 0.01] + [0.0, 1e4, 3.0]
    y = 5 + x @ [2.0, -0.3, 40.0] + rng.normal(size=n)
    rows = [(i, *map(float, v), 0.5, float(t)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, still double, y double").repartition(5)


@pytest.mark.parametrize("scaler", ["standard", "minmax", "none", "normalizer"])
def test_least_squares_of_all_folds_in_one_pass(spark, monkeypatch, scaler):
    """No model is fitted by itself, and the values are those of one fit per trial and fold; a feature may be constant."""
    table, task = odd_rows(spark), Task("id", ("a", "c") if scaler == "normalizer" else ("a", "b", "c"), "y", scaler=scaler)
    tuner = search.TUNERS["tune_linear"]
    want = search.search(table, task, dataclasses.replace(tuner, line=None), trials=6, k=3).trials.orderBy("trial").collect()
    monkeypatch.setattr(search, "fit_regressor", None)
    if scaler == "standard":  # which Spark solves by steps, to fewer digits
        task = dataclasses.replace(task, features=(*task.features, "still"))
    got = search.search(table, task, tuner, trials=6, k=3).trials.orderBy("trial").collect()
    assert [r["params"] for r in got] == [r["params"] for r in want] and len({r["params"] for r in got}) == 2
    assert [r["value"] for r in got] == pytest.approx([r["value"] for r in want], rel=1e-6)


def test_least_squares_of_dependent_features(spark):
    """Of several solutions the smallest: the guesses are those without the copy."""
    table = odd_rows(spark).withColumn("copy", F.col("a") * 3 - 7)
    values = [search.search(table, Task("id", f, "y"), search.TUNERS["tune_linear"], trials=6, k=3).trials.orderBy("trial").collect()
              for f in (("a", "b", "c"), ("a", "b", "c", "copy"))]
    assert [r["value"] for r in values[1]] == pytest.approx([r["value"] for r in values[0]], rel=1e-9)


def test_scores(spark):
    rng = np.random.default_rng(1)
    rows = [(i % 2, i % 3, float(rng.integers(0, 2)), float(rng.integers(0, 2)), float(rng.integers(0, 9))) for i in range(200)]
    t = spark.createDataFrame(rows, "trial int, _fold int, actual double, guess double, lead double")
    for metric in search.CLASS_METRICS:
        for r in search.fold_scores(t, metric).collect():
            own = [x[2:] for x in rows if x[:2] == (r["trial"], r["_fold"])]
            a, g, s = (np.array(c) for c in zip(*own))
            if metric == "accuracy":
                want = (a == g).mean()
            elif metric == "roc_auc":
                want = np.mean([(p > q) + 0.5 * (p == q) for p in s[a == 1] for q in s[a == 0]])
            else:
                tp = np.array([((a == c) & (g == c)).sum() for c in (0, 1)])
                p, q = tp / np.array([(g == c).sum() for c in (0, 1)]), tp / np.array([(a == c).sum() for c in (0, 1)])
                want = {"precision": p, "recall": q, "f1": 2 * p * q / (p + q)}[metric].mean()
            assert abs(r["value"] - want) < 1e-9, metric


@pytest.mark.parametrize("metric", ["roc_auc", "accuracy"])
def test_linear_search_over_all_penalties(table, metric):
    task = Task("id", ("a", "b", "c"), "two")
    found = search.search(table, task, search.TUNERS["tune_logistic"], metric, trials=6, k=2)
    assert found.value > 0.7 and found.trials.where("value is null").isEmpty()


@pytest.mark.parametrize("penalty,mix", [("l2", 0.0), ("l1", 1.0), ("elasticnet", 0.4)])
@pytest.mark.parametrize("target,classes", [("two", 2), ("kind", 3)])
def test_logistic_equals_a_single_fit(table, penalty, mix, target, classes):
    rows = table.withColumn("kind", F.when(F.col("k") == "macro avg", 2).otherwise(F.substring("k", 2, 1).cast("int")))
    split = rows.withColumn("_fold", (F.col("id") % 4).cast("int"))
    line = Line(classes, C=0.05, penalty=penalty, l1_ratio=0.4, scaler="none", max_iter=500)
    job = lines.jobs_of(split, ["a", "b", "c"], target, [line], 4)[1]
    data = split.select("_fold", F.col(target).cast("double").alias("_y"), F.array("a", "b", "c").alias("_x"))
    mine = lines.fit_lines(data, 3, [job])[0]
    train = VectorAssembler(inputCols=["a", "b", "c"], outputCol="x").transform(split.where("_fold != 1"))
    model = LogisticRegression(featuresCol="x", labelCol=target, regParam=1 / (0.05 * train.count()), elasticNetParam=mix, maxIter=500,
                               tol=1e-10, standardization=False, family="binomial" if classes == 2 else "multinomial").fit(train)
    other = model.coefficientMatrix.toArray().T
    assert np.abs(mine[:-1] - other).max() < 5e-3
    assert (mine[:-1] == 0).sum() == (np.abs(other) < 1e-12).sum() or mix < 1


def test_gradients_are_slopes_of_the_loss():
    rng = np.random.default_rng(5)
    z, label = np.column_stack([rng.normal(size=(40, 3)), np.ones(40)]), rng.integers(0, 3, 40).astype(float)
    for line, y in ((Line(3), label), (Line(2, balanced=True), np.minimum(label, 1)), (Line(0), rng.normal(size=40))):
        job = Job(line, 0, np.zeros(3), np.ones(3), 40, np.array([1.0, 2.0, 0.5])[:max(1, line.classes)], 0.1, 1.3)
        w = rng.normal(size=(4, job.outputs()))
        at = job.sums(z, y, w)
        for i in range(w.size):
            step = np.zeros(w.size)
            step[i] = 1e-6
            up, down = (job.sums(z, y, w + s * step.reshape(w.shape))[1] for s in (1, -1))
            assert abs((up - down) / 2e-6 - at[2 + i]) < 1e-4
            if line.classes:
                up, down = (job.sums(z, y, w + s * step.reshape(w.shape))[2:] for s in (1, -1))
                assert np.abs((up - down) / 2e-6 - job.curvature(z, y, w).reshape(w.size, w.size)[i]).max() < 1e-4


def test_both_solvers_end_at_the_same_point(table, monkeypatch):
    split = table.withColumn("_fold", (F.col("id") % 4).cast("int"))
    data = split.select("_fold", F.col("two").cast("double").alias("_y"), F.array("a", "b", "c").alias("_x"))
    jobs = lines.jobs_of(split, ["a", "b", "c"], "two", [Line(2, C=0.1, penalty=p) for p in ("l1", "l2", "none")], 4)[3:6]
    fast = lines.fit_lines(data, 3, jobs)
    monkeypatch.setattr(Job, "newton", lambda self: False)
    for a, b in zip(fast, lines.fit_lines(data, 3, jobs)):
        assert np.abs(a - b).max() < 2e-3


def test_tensor_sketch_estimates_the_kernel():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(60, 6)) / np.sqrt(6)
    exact = (a @ a.T) ** 3
    errors = []
    for seed in range(30):
        s = lines.tensor_sketch(a, *lines.sketch_tables(6, 3, 256, seed), 256)
        errors.append(s @ s.T - exact)
    size = np.sqrt(((a @ a.T).diagonal()[:, None] * (a @ a.T).diagonal()) ** 3)
    assert (np.sqrt(np.mean(np.square(errors), 0)) <= 3.0 ** 1.5 / np.sqrt(256) * size + 1e-9).mean() > 0.99  # variance bound
    assert np.abs(np.mean(errors, 0)).max() < 0.15 * size.max()


@pytest.mark.parametrize("kernel,floor", [("linear", 0.5), ("rbf", 0.7), ("poly", 0.8)])
def test_support_vector_regression(table, kernel, floor):
    split = table.withColumn("_fold", (F.col("id") % 4).cast("int"))
    if kernel == "poly":  # a cubic kernel learns cubic forms
        split = split.withColumn("y", F.col("a") ** 3 - 2 * F.col("a") * F.col("b") ** 2 + F.col("b") * F.col("c") * F.col("a"))
    found = lines.out_of_fold(split, ["a", "b", "c"], "y", [Line(0, C=10.0, kernel=kernel, max_iter=60)], 4)
    assert found.count() == 240
    assert r2_mae(found, "_y", "_p").first()["r2"] > floor
    with pytest.raises(ValueError):
        lines.out_of_fold(split, ["a"], "y", [Line(0, kernel="sigmoid")], 4)


def test_support_vector_jobs_share_their_mapped_features():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(300, 4)), rng.normal(size=300)
    tables = lines.sketch_tables(4, 3, 128, 1)
    direct, waves = lines.tensor_sketch(x, *tables, 128), lines.sketch_spectrum(x, *tables, 128)
    assert waves.shape == direct.shape and np.abs(waves @ waves.T - direct @ direct.T).max() < 1e-9
    odd = lines.sketch_tables(4, 3, 33, 1)
    assert np.abs(lines.sketch_spectrum(x, *odd, 33) @ lines.sketch_spectrum(x, *odd, 33).T
                  - lines.tensor_sketch(x, *odd, 33) @ lines.tensor_sketch(x, *odd, 33).T).max() < 1e-9
    assert np.abs(lines.cosine(50 * x) - np.cos(50 * x)).max() < 1e-13
    jobs = [lines.Job(Line(0, epsilon=e, kernel="poly"), f, x.mean(0), x.std(0), 300, np.ones(1), 0.1, 2.0, 0.3, tables)
            for f in (0, 1) for e in (0.01, 0.5)]
    assert lines._maps(jobs) == [[0, 1], [2, 3]]
    z, at = jobs[0].features(x), [rng.normal(size=jobs[0].width()) for _ in range(2)]
    for job, w, found in zip(jobs[:2], at, lines._tube_sums(jobs[:2], z, y, at)):
        assert np.allclose(found, job.sums(z, y, w[:, None]), rtol=1e-10, atol=1e-10)
