"""Faults found after the first round."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.operators import neighbors
from tabwright.operators.encode import encode_label
from tabwright.operators.evaluate import confusion_matrix
from tabwright.operators.impute import impute_mean
from tabwright.operators.models.search import optimization_history
from tabwright.operators.split import hash_bucket, train_test_split
from tabwright.sources.tables import read_csv, write_csv


def test_nearest_at_small_scale(spark):
    donors = spark.createDataFrame([(1, 1e-6), (2, 2e-6), (3, 5e-6), (4, 9e-6)], "id long, x double")
    query = spark.createDataFrame([(9, 5e-6)], "id long, x double")
    found = neighbors.knn_join(*[neighbors.one_group(t, "id", F.array("x")) for t in (query, donors)], 1).collect()
    assert [r.donor_id for r in found] == [3]


def test_significant_digits():
    x = np.array([0.0, 1e-300, 1.23456789012345e-11, 5.0, 7.0000000000001e20])
    y = neighbors.significant(x)
    assert (np.abs(y - x) <= 1e-11 * x).all() and y[3] == 5.0 and y[1] == 1e-300


def test_csv_quotes_newlines_and_encodings(spark, tmp_path):
    rows = [(1, 'say "hi", ok'), (2, "two\nlines"), (3, None), (4, "plain")]
    write_csv(spark.createDataFrame(rows, "id int, t string"), str(tmp_path / "out"))
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "out"), "id int, t string").collect())) == rows
    (tmp_path / "latin.csv").write_bytes("id,t\n1,café\n".encode("latin-1"))
    assert read_csv(spark, str(tmp_path / "latin.csv")).collect()[0].t == "café"


def test_missing_prediction_and_name_clash(spark):
    df = spark.createDataFrame([("a", "a"), ("b", None)], "y string, p string")
    got = {(r.actual, r.predicted): r.n for r in confusion_matrix(df, "y", "p").collect()}
    assert got[("a", "a")] == 1 and got[("b", None)] == 1 and len(got) == 9
    t = spark.createDataFrame([("x", 7), ("y", 8), ("x", 9)], "k string, code int")
    assert sorted(map(tuple, encode_label(t, "k").collect())) == [(0, 7), (0, 9), (1, 8)]


def test_history(spark):
    t = spark.createDataFrame([(0, 0.2), (1, None), (2, 0.1), (3, 0.5)], "trial int, value double")
    assert [r.best_so_far for r in optimization_history(t).orderBy("trial").collect()] == [0.2, 0.2, 0.2, 0.5]




@pytest.mark.parametrize("k", [1, 5, 25])
def test_null_features_have_no_neighbours(spark, k):
    rows = [(i, float(i % 10), float(i // 10), "x" if i % 10 < 5 else "y", float(i)) for i in range(60)]
    train = spark.createDataFrame([*rows, (100, None, 1.0, "x", 1e9)], "id long, a double, b double, c string, y double")
    test = spark.createDataFrame([(200, 1.0, 1.0, "x", 0.0), (201, None, 1.0, "x", 0.0), (202, 8.0, None, "y", 0.0)], train.schema)
    got = {r["id"]: r["prediction"] for r in neighbors.knn_classify(train, test, "id", ["a", "b"], "c", k).collect()}
    assert got == {200: "x", 201: None, 202: None}
    number = {r["id"]: r["prediction"] for r in neighbors.knn_regress(train, test, "id", ["a", "b"], "y", k).collect()}
    assert number[201] is None and number[202] is None and number[200] < 100


def test_replacement_character_in_a_utf8_file(spark, tmp_path):
    (tmp_path / "good.csv").write_bytes("name,n\ncafé,1\nodd � cell,2\n\"two\nlines\",3\n".encode())
    (tmp_path / "old.csv").write_bytes("name,n\ncafé,1\n".encode("latin-1"))
    assert [r["name"] for r in read_csv(spark, str(tmp_path / "good.csv")).orderBy("n").collect()] == ["café", "odd � cell", "two\nlines"]
    assert [r["name"] for r in read_csv(spark, str(tmp_path / "old.csv")).collect()] == ["café"]
    (tmp_path / "flat.csv").write_bytes("name,n\n".encode() + "é,1\n".encode() * 5_000)
    assert read_csv(spark, str(tmp_path / "flat.csv"), multi_line=False).count() == 5_000


def _masked_mean(x, k):
    """Every gap by the mean of the k nearest rows with a value there; squared differences over the shared columns, scaled up."""
    width, out, means = x.shape[1], x.copy(), np.nanmean(x, 0)
    for r, c in zip(*np.nonzero(np.isnan(x))):
        square = (x[r] - x) ** 2
        shared = (~np.isnan(square)).sum(1)
        near = np.nansum(square, 1) * width / np.maximum(shared, 1)
        able = np.flatnonzero((shared > 0) & ~np.isnan(x[:, c]))
        best = able[np.lexsort((able, neighbors.significant(near[able])))[:k]]
        out[r, c] = x[best, c].mean() if len(best) else means[c]
    return out


@pytest.mark.parametrize("n,width,blocks", [(500, 3, (32, 64)), (300, 12, None), (80, 70, None)])
def test_knn_imputation_of_any_gaps(spark, n, width, blocks):
    rng = np.random.default_rng(width)
    x = np.round(rng.normal(size=(n, width)), 2) + 40 * rng.integers(0, 9, n)[:, None]  # clusters, so that boxes exclude some
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:3], x[10:40] = np.nan, x[10]
    names = [f"c {i}" for i in range(width)]
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"`{c}` double" for c in names)).repartition(4)
    settings = dict(zip(("tabwright.neighbors.queryBlock", "tabwright.neighbors.donorBlock"), map(str, blocks or ())))
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        got = sorted(neighbors.impute_knn(df, names, "id").collect())
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert np.allclose(np.array([r[1:] for r in got], float), _masked_mean(x, 5), rtol=1e-9)


def test_boxes_bound_the_masked_distance():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4)) + 8 * rng.integers(0, 3, 60)[:, None]
    x[rng.random(x.shape) < 0.3] = np.nan
    parts = np.array_split(np.argsort(np.nan_to_num(x).sum(1)), 12)

    def side():
        s = object.__new__(neighbors._Side)
        s.count = np.array([len(p) for p in parts])
        s.values = np.array([(~np.isnan(x[p])).sum(0) for p in parts])
        s.low = np.array([np.where(np.isnan(x[p]), np.inf, x[p]).min(0) for p in parts])
        s.high = np.array([np.where(np.isnan(x[p]), -np.inf, x[p]).max(0) for p in parts])
        return s
    least = neighbors._least_masked(side(), side())
    assert (least > 0).any()
    for a, p in enumerate(parts):
        for b, q in enumerate(parts):
            square = (x[p][:, None] - x[q][None]) ** 2
            shared = (~np.isnan(square)).sum(2)
            true = np.where(shared > 0, np.nansum(square, 2) * 4 / np.maximum(shared, 1), np.inf)
            assert least[a, b] <= true.min() * (1 + 1e-12) + 1e-12


def test_shares_below_a_thousandth(spark):
    rows = spark.range(200_000).withColumn("k", F.col("id"))
    assert 40 <= train_test_split(rows, "k", 0.0004).where("split = 'test'").count() <= 130
    coarse = train_test_split(rows, "k", 0.2).where((F.col("split") == "test") != (hash_bucket(F.col("k")) < 200))
    assert coarse.isEmpty()


def test_filled_type_does_not_hang_on_the_mean(spark):
    for values in [(1, 3, None), (1, 2, None)]:
        filled = impute_mean(spark.createDataFrame([(v,) for v in values], "x int"), ["x"])
        assert dict(filled.dtypes) == {"x": "double"} and filled.where("x is null").isEmpty()


def test_few_patterns_of_gaps_are_joined_by_shared_columns(spark, monkeypatch):
    def boxes(*_):
        raise AssertionError("rows of all patterns would meet in blocks")
    monkeypatch.setattr(neighbors, "_masked_neighbours", boxes)
    rows = [(1, 0.0, 5.0, 1.0), (1, 9.0, 5.0, 2.0), (2, 1.0, None, 3.0), (3, None, 5.0, 2.0), (4, None, None, None), (5, None, 7.0, None)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")  # an id twice, with other values
    got = {(r["id"], r["c"]): r for r in neighbors.impute_knn(df, ["a", "b", "c"], "id", 1).collect()}
    assert got[3, 2.0]["a"] == 9.0 and got[2, 3.0]["b"] == 5.0 and got[5, 1.0]["a"] == 0.0
    assert got[4, 2.0]["a"] == 10 / 3 and got[4, 2.0]["b"] == 5.5
