"""The paths for large and skewed tables give the same answers as brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabwright.functions.columns import none_missing
from tabwright.operators import impute, missing, neighbors, ranks, scale, stats
from tabwright.operators.evaluate import roc_auc
from tabwright.operators.profile import describe_numeric


@pytest.fixture
def skewed(spark):
    """One key, and one value, hold a third of the rows."""
    rng = np.random.default_rng(1)
    n = 3000
    pdf = pd.DataFrame({"id": np.arange(n), "key": np.where(np.arange(n) % 3 == 0, "hot", (np.arange(n) % 7).astype(str)),
                        "v": np.where(np.arange(n) % 3 == 1, 5.0, rng.normal(size=n).round(3))})
    return spark.createDataFrame(pdf), pdf


def test_quantiles(skewed):
    df, pdf = skewed
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    assert stats.quantiles(df, ["v"], probs)["v"] == pytest.approx(list(pdf["v"].quantile(probs)))
    for r in stats.grouped_quantiles(df, ["v"], probs, ["key"]).collect():
        assert r["quantiles"] == pytest.approx(list(pdf[pdf["key"] == r["key"]]["v"].quantile(probs)))
    assert describe_numeric(df, ["v"]).first()["50%"] == pytest.approx(pdf["v"].median())


def test_quantiles_of_a_fine_grid(skewed):
    df, pdf = skewed
    probs = np.linspace(0, 1, 1000)
    assert stats.quantiles(df, ["v"], probs)["v"] == pytest.approx(list(pdf["v"].quantile(probs)))


def test_quantiles_without_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), (None, 5.0), (None, float("inf"))], "g string, v double")
    got = {r["g"]: r["quantiles"] for r in stats.grouped_quantiles(df, ["v"], [0.5, 1.0], ["g"]).collect()}
    assert got == {"a": [2.0, 3.0], "b": None, None: [float("inf"), float("inf")]}
    assert stats.quantiles(df.where("g = 'b'"), ["v"], [0.5]) == {"v": None}
    assert stats.quantiles(df.limit(0), ["v"], [0.5]) == {"v": None}


@pytest.fixture
def tight(spark, monkeypatch):
    """Few values may be gathered, so that parts are cut again and again."""
    monkeypatch.setattr(ranks, "PER_RANK", 60)
    spark.conf.set("tabwright.ranks.gathered", "1")
    yield
    spark.conf.unset("tabwright.ranks.gathered")


def test_ranks_by_cuts(spark, tight):
    rng = np.random.default_rng(5)
    n = 60_000
    pdf = pd.DataFrame({"normal": rng.normal(size=n), "one": np.full(n, 2.0), "whole": rng.integers(0, 30_000, n).astype(float),
                        "tied": np.where(rng.random(n) < 0.6, 5.0, rng.normal(size=n) * 10),
                        "ends": np.select([rng.random(n) < 0.3, rng.random(n) < 0.2], [np.inf, -np.inf], rng.normal(size=n))})
    df = spark.createDataFrame(pdf)
    wanted = [0, 1, 17, n // 4, n // 2, n // 2 + 1, n - 30, n - 1]
    got = ranks.values_at(df, list(pdf), lambda total: wanted)
    for c in pdf:
        assert got[c] == (n, dict(zip(wanted, np.sort(pdf[c])[wanted])))
    grid = np.linspace(0, 1, 300)
    assert stats.quantiles(df, ["normal"], grid)["normal"] == pytest.approx(list(pdf["normal"].quantile(grid)))


def test_ranks_with_gaps_and_nan(spark, tight):
    df = spark.range(5000).select(F.expr("case when id % 4 = 0 then double('nan') when id % 4 = 1 then null else id end").alias("v"),
                                  F.lit(None).cast("double").alias("none"))
    got = ranks.values_at(df, ["v", "none"], lambda total: [0, total // 2, total - 1])
    total, found = got["v"]
    assert total == 3750 and found[0] == 2.0 and found[1875] == 3751.0 and np.isnan(found[3749])
    assert got["none"] == (0, {})


@pytest.mark.parametrize("held", [100, 1_000_000])
def test_many_ranks_are_searched_by_batches(spark, tight, monkeypatch, held):
    """More cuts than are spelled out: arrays of values are searched, counted by task, and give the same ranks."""
    monkeypatch.setattr(ranks, "HELD", held)
    seen, right = [], ranks._summed_cells
    monkeypatch.setattr(ranks, "_summed_cells", lambda *a: seen.append(a[-1]) or right(*a))
    rng = np.random.default_rng(6)
    n = 20_000
    pdf = pd.DataFrame({"normal": rng.normal(size=n), "whole": rng.integers(-50, 50, n).astype(float),
                        "odd": rng.choice([np.inf, -np.inf, 0.0, -0.0, 2.5], n)})
    df = spark.createDataFrame(pdf).selectExpr("*", "CAST(whole AS DECIMAL(9, 2)) AS exact", "CAST(whole AS INT) AS number",
                                               "IF(whole > 20, NULL, IF(whole > 0, DOUBLE('nan'), normal)) AS gaps")
    gaps = pdf["normal"].where(pdf["whole"] <= 0)[pdf["whole"] <= 20].to_numpy()
    got = ranks.values_at(df, df.columns, lambda total: [int(x) for x in np.linspace(0, total - 1, 100)])
    for c, values in {**pdf, "exact": pdf["whole"], "number": pdf["whole"], "gaps": gaps}.items():
        wanted = [int(x) for x in np.linspace(0, len(values) - 1, 100)]
        assert got[c][0] == len(values)
        np.testing.assert_array_equal([got[c][1][w] for w in wanted], np.sort(values)[wanted])
    assert {True, False} == set(seen)  # counted values, and sketches of values


def test_a_wrong_sketch_costs_a_pass_only(skewed, monkeypatch, tight):
    df, pdf = skewed
    right, calls = ranks._sketch, []

    def wrong(*args):
        calls.append(args)
        shift = 1.0 if len(calls) == 1 else 0.0
        return [(s, counts, {p: (v - shift, w) for p, (v, w) in inside.items()}) for s, counts, inside in right(*args)]
    monkeypatch.setattr(ranks, "_sketch", wrong)
    spread = pdf["v"].to_numpy()
    assert stats.quantiles(df, ["v"], [0.0, 0.3, 0.9])["v"] == pytest.approx(list(np.quantile(spread, [0.0, 0.3, 0.9])))
    assert len(calls) > 1


def test_modes_keep_the_type(spark):
    from decimal import Decimal
    big = 2 ** 53 + 1
    df = spark.createDataFrame([("a", big, Decimal("1.10"), 2.5, "x"), ("a", big, Decimal("1.10"), 2.5, "x"), ("a", big - 1, Decimal("9.99"), 1.0, "y"),
                                ("b", None, None, None, None), ("b", big + 2, Decimal("7.00"), 3.5, "z")],
                               "g string, i long, d decimal(20,2), f double, t string")
    assert stats.modes(df, ["i", "d", "f", "t"]) == {"i": big, "d": Decimal("1.10"), "f": 2.5, "t": "x"}
    assert stats.modes(df.where("i is null"), ["i", "t"]) == {"i": None, "t": None}
    filled = impute.impute_mode(df, ["i", "d"]).where("t is null").first()
    assert (filled["i"], filled["d"]) == (big, Decimal("1.10"))
    grouped = impute.impute_grouped(df, ["g"], ["i", "t"], "mode").where("f is null").first()
    assert (grouped["i"], grouped["t"]) == (big + 2, "z")


def test_positions_and_ranks(skewed):
    df, pdf = skewed
    got = {r["id"]: r["position"] for r in stats.row_positions(df, ["v", "id"]).collect()}
    want = pdf.sort_values(["v", "id"])["id"].tolist()
    assert [got[i] for i in want] == list(range(len(want)))
    cells = df.groupBy(F.col("v").alias("value")).agg(F.count("*").alias("n"))
    mean_ranks = {r["value"]: r["rank"] for r in stats.average_ranks(cells).collect()}
    assert pdf["v"].map(mean_ranks).tolist() == pdf["v"].rank().tolist()


def test_interpolation_across_slabs(skewed):
    df, pdf = skewed
    holed = df.withColumn("v", F.when(~F.col("id").between(500, 1900) & (F.col("id") % 4 != 0), F.col("v")))
    local = pdf.assign(v=pdf["v"].where(~pdf["id"].between(500, 1900) & (pdf["id"] % 4 != 0)))
    for by, limit in (([], None), (["key"], None), (["key"], 2)):
        got = impute.impute_interpolate_linear(holed, "v", ["id"], "forward", limit, by).toPandas().set_index("id")["v"].sort_index()
        series = local.groupby("key")["v"] if by else local["v"]
        want = (series.transform(lambda s: s.interpolate("linear", limit=limit)) if by else series.interpolate("linear"))
        assert np.allclose(got.to_numpy(dtype=float), want.to_numpy(), equal_nan=True)


@pytest.mark.parametrize("method,degree", [("cubic", 3), ("quadratic", 2)])
def test_spline_blocks_match_one_global_spline(spark, monkeypatch, method, degree):
    monkeypatch.setattr(impute, "SPLINE_BLOCK", 64)
    rng = np.random.default_rng(2)
    y = np.cumsum(rng.normal(size=600))
    known = rng.uniform(size=600) < 0.7
    known[[0, -1]] = True
    df = spark.createDataFrame([(i, float(v) if k else None) for i, (v, k) in enumerate(zip(y, known))], "i int, y double")
    got = [r["y"] for r in impute.impute_interpolate_spline(df, "y", ["i"], method).orderBy("i").collect()]
    x = np.flatnonzero(known).astype(float)
    knots, coef = impute._spline_pieces(x, y[known], degree)
    want = impute._spline_basis(np.arange(600.0), knots, degree) @ coef
    assert np.allclose(got, want, atol=1e-6)
    assert np.allclose(np.array(got)[known], y[known])


def brute(queries, donors, k, p=2, skip_self=False):
    out = {}
    for i, q in queries:
        d = [((np.abs(np.array(q) - np.array(f)) ** p).sum() ** (1 / p), j) for j, f in donors if not (skip_self and i == j)]
        out[i] = [j for _, j in sorted((round(a ** 2, 9), j) for a, j in d)[:k]]
    return out


@pytest.mark.parametrize("p", [1, 2])
def test_knn_join_is_exact_with_copies_and_small_blocks(spark, p):
    rng = np.random.default_rng(3)
    points = [(i, [0.5, 0.5] if i % 3 == 0 else rng.normal(size=2).round(2).tolist()) for i in range(400)]
    df = spark.createDataFrame([(0, i, f) for i, f in points], "group int, id long, features array<double>")
    spark.conf.set("tabwright.neighbors.queryBlock", "16")
    spark.conf.set("tabwright.neighbors.donorBlock", "32")
    try:
        rows = neighbors.knn_join(df, df, 4, exclude_self=True, p=p).orderBy("query_id", "rank").collect()
    finally:
        spark.conf.unset("tabwright.neighbors.queryBlock")
        spark.conf.unset("tabwright.neighbors.donorBlock")
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], []).append(r["donor_id"])
    assert got == brute(points, points, 4, p, True)


def test_knn_join_keeps_groups_apart(spark):
    rng = np.random.default_rng(4)
    rows = [("a" if i % 4 else "b", i, rng.normal(size=3).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "group string, id long, features array<double>")
    got = {}
    for r in neighbors.knn_join(df, df, 3, exclude_self=True).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["donor_id"])
    for g in "ab":
        points = [(i, f) for name, i, f in rows if name == g]
        assert {i: got[i] for i, _ in points} == brute(points, points, 3, 2, True)


def test_smote_balances_and_interpolates(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(x), float(y), "big" if i < 90 else "small") for i, (x, y) in enumerate(rng.normal(size=(120, 2)))]
    df = spark.createDataFrame(rows, "id int, x double, y double, c string")
    out = neighbors.smote(df, "id", ["x", "y"], "c")
    assert {r["c"]: r["count"] for r in out.groupBy("c").count().collect()} == {"big": 90, "small": 90}
    small = np.array([(r[1], r[2]) for r in rows if r[3] == "small"])
    for r in out.where("synthetic = 1").collect():
        p = np.array([r["x"], r["y"]])
        ends = [(a, b) for a in small for b in small if abs((b - a)[0] * (p - a)[1] - (b - a)[1] * (p - a)[0]) < 1e-9
                and min(a[0], b[0]) - 1e-9 <= p[0] <= max(a[0], b[0]) + 1e-9]
        assert ends
    again = neighbors.smote(df, "id", ["x", "y"], "c").where("synthetic = 1").orderBy("x").collect()
    assert again == out.where("synthetic = 1").orderBy("x").collect()


def test_power_fit_finds_the_best_exponent(spark):
    rng = np.random.default_rng(6)
    x = np.exp(rng.normal(size=2000))
    fitted = scale.fit_power(spark.createDataFrame([(float(v),) for v in x], "v double"), "v", "box-cox")

    def score(lam):
        y = np.log(x) if lam == 0 else (x ** lam - 1) / lam
        return -len(x) / 2 * np.log(y.var()) + (lam - 1) * np.log(x).sum()
    assert score(fitted.lam) >= max(score(fitted.lam + d) for d in (-1e-4, 1e-4, -0.01, 0.01))
    assert abs(fitted.lam) < 0.1


def test_factorisation_beats_the_mean(spark):
    rng = np.random.default_rng(7)
    u, v = rng.normal(size=(800, 2)), rng.normal(size=(5, 2))
    full = u @ v.T + rng.normal(scale=0.05, size=(800, 5))
    gone = rng.uniform(size=full.shape) < 0.1
    names = [f"c{i}" for i in range(5)]
    df = spark.createDataFrame([[i, *[None if g else float(x) for x, g in zip(r, m)]] for i, (r, m) in enumerate(zip(full, gone))],
                               "i int, " + ", ".join(f"{n} double" for n in names))
    out = impute.impute_matrix_factorization(df, names, rank=2).orderBy("i").toPandas()[names].to_numpy()
    assert np.array_equal(out[~gone], full[~gone])
    means = np.broadcast_to(np.nanmean(np.where(gone, np.nan, full), axis=0), full.shape)
    assert ((out - full)[gone] ** 2).mean() < 0.3 * ((means - full)[gone] ** 2).mean()


def test_auc_and_missing_p_values(spark):
    rng = np.random.default_rng(8)
    s = rng.normal(size=500).round(1)
    y = (s + rng.normal(size=500) > 0).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean())
    assert roc_auc(df, "y", "s").first()[0] == pytest.approx(want)
    holed = df.withColumn("z", F.when(F.col("s") < 1, 1.0))
    r = missing.missing_mar_correlation(holed, "z", ["s"]).first()
    local = pd.DataFrame({"s": s, "m": (s >= 1).astype(int)})
    assert r["rho"] == pytest.approx(local["s"].rank().corr(local["m"].rank()))
    assert r["significant"]


def test_wide_filters_stay_plannable(spark):
    wide = spark.range(10).select(*[F.when(F.col("id") > 0, F.col("id").cast("double") + i).alias(f"c{i}") for i in range(60)])
    assert wide.where(none_missing(wide.columns)).select(*[(F.col(c) + 1).alias(c) for c in wide.columns]).count() == 9
    assert impute.drop_missing_rows(wide, 60).count() == 9
