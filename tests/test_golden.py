"""Hand-computed answers on five-row tables."""

import pytest
from pyspark.sql import functions as F

from tabwright.operators import encode, evaluate, impute, outliers, project, scale, select


def column(df, name, order="i"):
    return [r[0] for r in df.orderBy(order).select(name).collect()]


@pytest.fixture
def g1(spark):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 4, 100])], "i int, v double")


@pytest.fixture
def g2(spark):
    return spark.createDataFrame(list(zip(range(1, 6), "baabc", [1.0, 2.0, 4.0, 3.0, 5.0])), "i int, k string, t double")


@pytest.fixture
def g3(spark):
    return spark.createDataFrame(list(enumerate([None, 1.0, None, 3.0, None])), "i int, x double")


def test_outlier_rules(g1):
    f = outliers.fit_iqr(g1, "v")
    assert (f.low, f.high) == (-1.0, 7.0)
    assert column(outliers.outlier_iqr(g1, "v"), "is_outlier") == [0, 0, 0, 0, 1]
    assert column(outliers.winsorize(g1, "v"), "v") == [1, 2, 3, 4, 7]
    assert column(outliers.winsorize(g1, "v", "bottom"), "v") == [1, 2, 3, 4, 100]
    assert column(outliers.outlier_mean_std(g1, "v"), "is_outlier") == [0] * 5
    assert column(outliers.outlier_mad(g1, "v"), "is_outlier") == [0, 0, 0, 0, 1]
    assert outliers.drop_outliers(g1, "v").count() == 4


def test_scalers(g1):
    assert column(scale.scale_standard(g1, "v"), "v_scaled") == pytest.approx(
        [-0.538285, -0.512652, -0.487019, -0.461387, 1.999343], abs=1e-6)
    assert column(scale.scale_robust(g1, "v"), "v_robust_scaled") == [-1, -0.5, 0, 0.5, 48.5]
    assert column(scale.scale_minmax(g1, "v"), "v_minmax_scaled") == pytest.approx([0, 1 / 99, 2 / 99, 3 / 99, 1])
    assert column(scale.normalize_l2(g1, "v"), "v_normalized") == [1] * 5
    row = scale.polynomial(g1, "v", 2).where("v = 3").first()
    assert (row["v_poly_0"], row["v_poly_1"], row["v_poly_2"]) == (1, 3, 9)


def test_constant_columns_scale_by_one(spark):
    flat = spark.createDataFrame([(1, 5.0), (2, 5.0)], "i int, v double")
    for fn, name in ((scale.scale_standard, "v_scaled"), (scale.scale_minmax, "v_minmax_scaled"), (scale.scale_robust, "v_robust_scaled")):
        assert column(fn(flat, "v"), name) == [0, 0]


def test_encodings(g2):
    assert column(encode.encode_label(g2, "k"), "k") == [1, 0, 0, 1, 2]
    assert encode.encode_one_hot(g2, "k").columns == ["i", "t", "k_a", "k_b", "k_c"]
    assert column(encode.encode_mean(g2, "k", "t"), "k_mean_encoded") == [2, 3, 3, 2, 5]
    assert column(encode.encode_target(g2, "k", "t"), "k") == [2, 3, 3, 2, 5]
    assert column(encode.encode_frequency(g2, "k"), "k_freq_encoded") == [2, 2, 2, 2, 1]
    b = encode.encode_binary(g2, "k", ["i"])
    assert column(b, "k_bin_0") == [0, 0, 0, 0, 1] and column(b, "k_bin_1") == [0, 1, 1, 0, 0]
    two = g2.where("k <> 'c'")
    assert encode.encode_one_hot(two, "k").columns == two.columns  # two values are left alone


def test_large_lookups_take_the_shuffled_path(spark, g2):
    spark.conf.set("tabwright.lookup.maxRows", "1")
    try:
        assert column(encode.encode_label(g2, "k"), "k") == [1, 0, 0, 1, 2]
        assert column(encode.encode_frequency(g2, "k"), "k_freq_encoded") == [2, 2, 2, 2, 1]
        b = encode.encode_binary(g2, "k", ["i"])
        assert column(b, "k_bin_0") == [0, 0, 0, 0, 1]
    finally:
        spark.conf.unset("tabwright.lookup.maxRows")


def test_mode_takes_the_smallest_tie(g2):
    holed = g2.union(g2.sparkSession.createDataFrame([(6, None, 0.0)], g2.schema))
    assert column(impute.impute_mode(holed, ["k"]), "k")[-1] == "a"


def test_interpolation(g3):
    def run(*args):
        return column(impute.impute_interpolate_linear(g3, "x", ["i"], *args), "x")
    assert run("forward") == [None, 1, 2, 3, 3]
    assert run("backward") == [1, 1, 2, 3, None]
    assert run("both") == [1, 1, 2, 3, 3]
    assert column(impute.impute_mean(g3, ["x"]), "x") == [2, 1, 2, 3, 2]
    assert column(impute.missing_indicator(g3, ["x"]), "x_is_missing") == [1, 0, 1, 0, 1]


def test_chi_square(spark):
    t = spark.createDataFrame([(1.0, 0), (0.0, 0), (3.0, 1), (0.0, 1)], "f double, c int")
    assert select.chi2_scores(t, ["f"], "c").first()["chi2"] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        select.chi2_select_k(t, ["f"], "c", 2)


def test_report(spark):
    t = spark.createDataFrame(list(zip("aabb", "abbc")), "actual string, predicted string")
    rows = {r["label"]: r for r in evaluate.classification_report(t, "actual", "predicted").collect()}
    assert rows["accuracy"]["f1"] == 0.5
    assert (rows["a"]["precision"], rows["a"]["recall"]) == (1, 0.5) and rows["a"]["f1"] == pytest.approx(2 / 3)
    assert (rows["b"]["precision"], rows["b"]["recall"], rows["b"]["f1"]) == (0.5, 0.5, 0.5)
    assert (rows["c"]["precision"], rows["c"]["recall"], rows["c"]["support"]) == (0, 0, 0)
    assert evaluate.confusion_matrix(t, "actual", "predicted").agg(F.sum("n")).first()[0] == 4


def test_filters_take_values_not_code(g2):
    assert project.filter_compare(g2, [("k", "==", "a"), ("t", ">", 2)]).count() == 1
    with pytest.raises(ValueError):
        project.filter_compare(g2, [("k", "or 1=1", "a")])


def test_duplicates(g2):
    assert column(impute.drop_duplicates(g2, ["i"], ["k"]), "i") == [1, 2, 5]
    assert column(impute.drop_duplicates(g2, ["i"], ["k"], "last"), "i") == [3, 4, 5]
    assert column(impute.drop_duplicates(g2, ["i"], ["k"], False), "i") == [5]
