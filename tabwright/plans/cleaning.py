"""Missing values, duplicates and outliers."""

from __future__ import annotations

from itertools import combinations


from tabwright.functions.columns import round_doubles
from tabwright.operators import impute, missing, outliers
from tabwright.plans.registry import NULLED, blanks, query, r, with_nulls
from tabwright.plans.sources import MISSING_COLUMNS, MISSING_SQL
from tabwright.sources import load_table

NAMES = [c for c, _ in MISSING_COLUMNS]
HOLED = [c for c in NAMES if c != "event_id"]


@query("check_missing", MISSING_SQL)
def check_missing(spark, sf):
    return round_doubles(missing.check_missing(blanks(spark, sf)))


@query("missing_ranked", f"WITH {NULLED} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing,
    {r(f"(count(*) - count({c})) / count(*) * 100", 2)} AS percentage FROM nulled""" for c in NAMES))
def missing_ranked(spark, sf):
    return missing.missing_ranked(blanks(spark, sf))


@query("missing_matrix", f"WITH {NULLED} SELECT event_id, " + ", ".join(f"({c} IS NULL)::INT AS {c}" for c in HOLED)
       + " FROM nulled")
def missing_matrix(spark, sf):
    return missing.missing_matrix(blanks(spark, sf), ["event_id"])


def _pair_sql(columns, expr: str, name: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, {expr.format(a=a, b=b)} AS {name} FROM nulled"
        for a, b in combinations(columns, 2))


INDICATOR_CORR = """CASE WHEN stddev_pop(({a} IS NULL)::INT) > 0 AND stddev_pop(({b} IS NULL)::INT) > 0
  THEN round(corr(({a} IS NULL)::INT, ({b} IS NULL)::INT), 6) + 0.0 END"""


@query("missing_correlation", f"WITH {NULLED} " + _pair_sql(NAMES, INDICATOR_CORR, "correlation"))
def missing_correlation(spark, sf):
    return round_doubles(missing.missing_correlation(blanks(spark, sf)))


@query("missing_correlation_partial", f"WITH {NULLED} " + _pair_sql(HOLED, INDICATOR_CORR, "correlation"))
def missing_correlation_partial(spark, sf):
    return round_doubles(missing.missing_correlation(blanks(spark, sf), partly_only=True))


@query("missing_cooccurrence", f"WITH {NULLED} SELECT * FROM (" + _pair_sql(
    HOLED, "count(*) FILTER ({a} IS NULL AND {b} IS NULL)", "both_missing")
    + ") ORDER BY both_missing DESC, column_a, column_b LIMIT 15")
def missing_cooccurrence(spark, sf):
    return missing.missing_cooccurrence(blanks(spark, sf))


@query("missing_patterns_top", f"WITH {NULLED} SELECT " + ", ".join(
    f"CASE WHEN {c} IS NULL THEN 'Missing' ELSE 'Present' END AS {c}" for c in HOLED)
    + f", count(*) AS frequency FROM nulled GROUP BY ALL ORDER BY frequency DESC, {', '.join(HOLED)} LIMIT 10")
def missing_patterns_top(spark, sf):
    return missing.missing_patterns_top(blanks(spark, sf).drop("event_id"))


@query("missing_monotone", f"""WITH {NULLED}, v AS (SELECT count(*) FILTER (k_n IS NULL AND user_n IS NOT NULL
  OR user_n IS NULL AND value_n IS NOT NULL) AS violations FROM nulled)
  SELECT (violations = 0)::INT AS monotone, violations FROM v""")
def missing_monotone(spark, sf):
    return missing.missing_monotone(blanks(spark, sf).select("value_n", "user_n", "k_n"))


@query("missing_monotone_nested", f"""WITH {NULLED}, v AS (SELECT count(*) FILTER (k_n IS NULL AND value_n IS NOT NULL) AS violations
  FROM nulled) SELECT (violations = 0)::INT AS monotone, violations FROM v""")
def missing_monotone_nested(spark, sf):
    return missing.missing_monotone(blanks(spark, sf).select("value_n", "k_n"))


@query("missing_overall_share", f"""WITH {NULLED}, s AS (SELECT CAST(sum({' + '.join(f'({c} IS NULL)::INT' for c in HOLED)}) AS BIGINT)
  AS missing_cells, count(*) * 6 AS cells FROM nulled)
  SELECT missing_cells, cells, {r('missing_cells / cells')} AS share,
  CASE WHEN missing_cells / cells < 0.05 THEN 'simple imputation' ELSE 'model-based imputation' END AS advice FROM s""")
def missing_overall_share(spark, sf):
    return round_doubles(missing.missing_overall_share(blanks(spark, sf)))


MCAR = ["value_n", "user_n", "k_n"]


@query("mcar_test", f"""WITH {NULLED}, c AS ({_pair_sql(MCAR, "corr(({a} IS NULL)::INT, ({b} IS NULL)::INT)", "c")})
  SELECT {r('((SELECT count(*) FROM nulled) - 1) * sum(c * c)', 4)} AS chi_square, 3.0::DOUBLE AS dof FROM c""")
def mcar_test(spark, sf):
    t = missing.mcar_test(blanks(spark, sf).select(*MCAR))
    return spark.createDataFrame([(round(t["chi_square"], 4), float(t["dof"]))], "chi_square double, dof double")


@query("mcar_p_value")
def mcar_p_value(spark, sf):
    t = missing.mcar_test(blanks(spark, sf).select(*MCAR))
    return spark.createDataFrame([(t["p_value"],)], "p_value double")


def _mar_sql() -> str:
    parts = []
    for c in ("value", "user_id", "k_n"):
        parts.append(f"""SELECT '{c}' AS variable, {r('corr(rk, m)')} AS rho, count(*) AS n FROM (
          SELECT (type_n IS NULL)::INT AS m, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS rk
          FROM nulled WHERE {c} IS NOT NULL)""")
    return f"WITH {NULLED} " + " UNION ALL ".join(parts)


@query("missing_mar_correlation", _mar_sql())
def missing_mar_correlation(spark, sf):
    t = missing.missing_mar_correlation(with_nulls(spark, sf), "type_n", ["value", "user_id", "k_n"])
    return round_doubles(t.select("variable", "rho", "n"))


@query("missing_mar_p_values")
def missing_mar_p_values(spark, sf):
    return missing.missing_mar_correlation(with_nulls(spark, sf), "type_n", ["value", "user_id", "k_n"]).select(
        "variable", "p_value", "significant")


@query("missing_group_ttest", f"""WITH {NULLED}, s AS (SELECT avg(value) FILTER (user_n IS NOT NULL) AS m1,
    var_samp(value) FILTER (user_n IS NOT NULL) AS v1, count(value) FILTER (user_n IS NOT NULL) AS n1,
    avg(value) FILTER (user_n IS NULL) AS m2, var_samp(value) FILTER (user_n IS NULL) AS v2,
    count(value) FILTER (user_n IS NULL) AS n2 FROM nulled)
  SELECT {r('(m1 - m2) / sqrt(v1 / n1 + v2 / n2)')} AS t,
    {r('(v1 / n1 + v2 / n2) * (v1 / n1 + v2 / n2) / ((v1 / n1) * (v1 / n1) / (n1 - 1) + (v2 / n2) * (v2 / n2) / (n2 - 1))', 4)} AS dof,
    n1 AS n_present, n2 AS n_missing FROM s""")
def missing_group_ttest(spark, sf):
    t = missing.missing_group_ttest(with_nulls(spark, sf), "value", "user_n")
    return round_doubles(t.drop("p_value"), dof=4)


@query("missing_group_ttest_p")
def missing_group_ttest_p(spark, sf):
    return missing.missing_group_ttest(with_nulls(spark, sf), "value", "user_n").select("p_value")


def box_sql(value: str, by: str, source: str) -> str:
    """Box statistics of ``value`` per ``by``; ``source`` has both columns."""
    return f"""b AS (SELECT {by} AS g, min({value}) AS mn, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS md,
      quantile_cont({value}, 0.75) AS q3, max({value}) AS mx FROM {source} WHERE {value} IS NOT NULL GROUP BY {by}),
    i AS (SELECT {by} AS g, {value} AS v, {value} >= q1 - 1.5 * (q3 - q1) AND {value} <= q3 + 1.5 * (q3 - q1) AS inside
      FROM {source} JOIN b ON {by} = g WHERE {value} IS NOT NULL),
    w AS (SELECT g, min(v) FILTER (inside) AS lo, max(v) FILTER (inside) AS hi, count(*) FILTER (NOT inside) AS outliers, count(*) AS n
      FROM i GROUP BY g)
    SELECT b.g AS {by}, {r('mn')} AS min, {r('q1')} AS q1, {r('md')} AS median, {r('q3')} AS q3, {r('mx')} AS max,
      {r('lo')} AS lower_whisker, {r('hi')} AS upper_whisker, outliers, n FROM b JOIN w ON b.g = w.g"""


@query("missing_group_box", f"""WITH {NULLED}, s AS (SELECT CASE WHEN user_n IS NULL THEN 'Missing' ELSE 'Present' END AS status,
  value FROM nulled), {box_sql('value', 'status', 's')}""")
def missing_group_box(spark, sf):
    return round_doubles(missing.missing_group_box(with_nulls(spark, sf), "value", "user_n"))


FOUR = ["value_n", "user_n", "type_n", "k_n"]
PRESENT = " + ".join(f"({c} IS NOT NULL)::INT" for c in FOUR)


@query("drop_missing_rows", f"WITH {NULLED} SELECT event_id, {', '.join(FOUR)} FROM nulled WHERE {PRESENT} = 4")
def drop_missing_rows(spark, sf):
    return impute.drop_missing_rows(blanks(spark, sf).drop("sparse_n"))


@query("drop_missing_rows_thresh", f"WITH {NULLED} SELECT event_id, {', '.join(FOUR)} FROM nulled WHERE 1 + {PRESENT} >= 4")
def drop_missing_rows_thresh(spark, sf):
    return impute.drop_missing_rows(blanks(spark, sf).drop("sparse_n"), 4)


@query("drop_missing_cols", f"WITH {NULLED} SELECT event_id FROM nulled")
def drop_missing_cols(spark, sf):
    return impute.drop_missing_cols(blanks(spark, sf))


@query("drop_sparse_columns", f"WITH {NULLED} SELECT event_id, {', '.join(FOUR)} FROM nulled")
def drop_sparse_columns(spark, sf):
    return impute.drop_sparse_columns(blanks(spark, sf))


@query("missing_indicator", f"WITH {NULLED} SELECT event_id, {', '.join(HOLED)}, "
       + ", ".join(f"({c} IS NULL)::INT AS {c}_is_missing" for c in HOLED) + " FROM nulled")
def missing_indicator(spark, sf):
    return impute.missing_indicator(blanks(spark, sf))


@query("impute_arbitrary", f"WITH {NULLED} SELECT event_id, coalesce(value_n, -1) AS value_n, coalesce(k_n, -1) AS k_n FROM nulled")
def impute_arbitrary(spark, sf):
    return impute.impute_arbitrary(blanks(spark, sf).select("event_id", "value_n", "k_n"), ["value_n", "k_n"], -1)


@query("impute_mean", f"""WITH {NULLED} SELECT event_id, {r('coalesce(value_n, avg(value_n) OVER ())')} AS value_n,
  {r('coalesce(user_n, avg(user_n) OVER ())')} AS user_n FROM nulled""")
def impute_mean(spark, sf):
    return round_doubles(impute.impute_mean(blanks(spark, sf).select("event_id", "value_n", "user_n"), ["value_n", "user_n"]))


@query("impute_median", f"""WITH {NULLED} SELECT event_id, {r('coalesce(value_n, (SELECT quantile_cont(value_n, 0.5) FROM nulled))')} AS value_n,
  {r('coalesce(k_n, (SELECT quantile_cont(k_n, 0.5) FROM nulled))')} AS k_n FROM nulled""")
def impute_median(spark, sf):
    return round_doubles(impute.impute_median(blanks(spark, sf).select("event_id", "value_n", "k_n"), ["value_n", "k_n"]))


def mode_sql(c: str, table: str = "nulled") -> str:
    return f"(SELECT {c} FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query("impute_mode", f"""WITH {NULLED} SELECT event_id, coalesce(type_n, {mode_sql('type_n')}) AS type_n,
  coalesce(user_n, {mode_sql('user_n')}) AS user_n FROM nulled""")
def impute_mode(spark, sf):
    return impute.impute_mode(blanks(spark, sf).select("event_id", "type_n", "user_n"), ["type_n", "user_n"])


@query("impute_simple", f"""WITH {NULLED} SELECT event_id, coalesce(type_n, 'missing_value') AS type_n,
  coalesce(user_n, 0) AS user_n, coalesce(k_n, {mode_sql('k_n')}) AS k_n FROM nulled""")
def impute_simple(spark, sf):
    t = blanks(spark, sf).select("event_id", "type_n", "user_n", "k_n")
    return impute.impute_simple(impute.impute_simple(t, ["type_n", "user_n"], "constant"), ["k_n"], "most_frequent")


def _interpolation_sql(direction: str, limit: int | None = None, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    after = "pp IS NOT NULL" + (f" AND i - pp <= {limit}" if limit else "")
    before = "np IS NOT NULL" + (f" AND np - i <= {limit}" if limit else "")
    allowed = {"forward": after, "backward": before, "both": f"({after}) OR ({before})"}[direction]
    return f"""WITH {NULLED}, p AS (SELECT event_id, value_n, event_type, row_number() OVER ({part}ORDER BY event_id) AS i FROM nulled),
      w AS (SELECT event_id, value_n, i,
        max(CASE WHEN value_n IS NOT NULL THEN i END) OVER ({part}ORDER BY event_id) AS pp,
        min(CASE WHEN value_n IS NOT NULL THEN i END) OVER ({part}ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS np,
        last_value(value_n IGNORE NULLS) OVER ({part}ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
        first_value(value_n IGNORE NULLS) OVER ({part}ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM p)
      SELECT event_id, {r(f'''CASE WHEN value_n IS NOT NULL THEN value_n WHEN {allowed} THEN
        CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a + (b - a) * (i - pp) / (np - pp) ELSE coalesce(a, b) END END''')} AS value_n FROM w"""


@query("impute_interpolate_linear", _interpolation_sql("forward"))
def impute_interpolate_linear(spark, sf):
    return round_doubles(impute.impute_interpolate_linear(
        blanks(spark, sf).select("event_id", "value_n"), "value_n", ["event_id"]))


@query("impute_interpolate_linear_grouped", _interpolation_sql("both", 1, "event_type"))
def impute_interpolate_linear_grouped(spark, sf):
    t = with_nulls(spark, sf).select("event_id", "event_type", "value_n")
    return round_doubles(impute.impute_interpolate_linear(t, "value_n", ["event_id"], "both", 1, ["event_type"])).drop("event_type")


@query("impute_interpolate_linear_backward", _interpolation_sql("backward"))
def impute_interpolate_linear_backward(spark, sf):
    return round_doubles(impute.impute_interpolate_linear(
        blanks(spark, sf).select("event_id", "value_n"), "value_n", ["event_id"], "backward"))


@query("impute_interpolate_spline")
def impute_interpolate_spline(spark, sf):
    return impute.impute_interpolate_spline(with_nulls(spark, sf).select("event_id", "event_type", "value_n"), "value_n",
                                            ["event_id"], "cubic", ["event_type"])


@query("impute_interpolate_quadratic")
def impute_interpolate_quadratic(spark, sf):
    return impute.impute_interpolate_spline(with_nulls(spark, sf).select("event_id", "value_n"), "value_n",
                                            ["event_id"], "quadratic")


@query("impute_grouped", f"""WITH {NULLED}, g AS (SELECT type_n AS t, avg(value_n) AS m FROM nulled WHERE type_n IS NOT NULL GROUP BY type_n)
  SELECT event_id, type_n, {r('coalesce(value_n, m, (SELECT avg(value_n) FROM nulled))')} AS value_n FROM nulled LEFT JOIN g ON type_n = t""")
def impute_grouped(spark, sf):
    return round_doubles(impute.impute_grouped(blanks(spark, sf).select("event_id", "type_n", "value_n"), ["type_n"], ["value_n"]))


@query("impute_grouped_median", f"""WITH {NULLED}, g AS (SELECT type_n AS t, quantile_cont(value_n, 0.5) AS m FROM nulled
    WHERE type_n IS NOT NULL GROUP BY type_n)
  SELECT event_id, type_n, {r('coalesce(value_n, m, (SELECT quantile_cont(value_n, 0.5) FROM nulled))')} AS value_n
  FROM nulled LEFT JOIN g ON type_n = t""")
def impute_grouped_median(spark, sf):
    return round_doubles(impute.impute_grouped(blanks(spark, sf).select("event_id", "type_n", "value_n"), ["type_n"],
                                               ["value_n"], "median"))


@query("impute_grouped_mode", f"""WITH {NULLED}, c AS (SELECT user_id, type_n, count(*) AS n FROM nulled WHERE type_n IS NOT NULL GROUP BY ALL),
  g AS (SELECT user_id AS u, first(type_n ORDER BY n DESC, type_n) AS m FROM c GROUP BY user_id)
  SELECT event_id, user_id, coalesce(type_n, m, {mode_sql('type_n')}) AS type_n FROM nulled LEFT JOIN g ON user_id = u""")
def impute_grouped_mode(spark, sf):
    return impute.impute_grouped(with_nulls(spark, sf).select("event_id", "user_id", "type_n"), ["user_id"], ["type_n"], "mode")


@query("impute_random_forest")
def impute_random_forest(spark, sf):
    return impute.impute_random_forest(blanks(spark, sf).select("event_id", "value_n", "k_n"), ["value_n"])


@query("impute_matrix_factorization")
def impute_matrix_factorization(spark, sf):
    return impute.impute_matrix_factorization(blanks(spark, sf).select("event_id", "value_n", "user_n", "k_n"),
                                              ["value_n", "user_n", "k_n"])


AUTO = f"""c AS (SELECT event_id, coalesce(value_n, avg(value_n) OVER ()) AS value_n, coalesce(user_n, avg(user_n) OVER ()) AS user_n,
  coalesce(type_n, {mode_sql('type_n')}) AS type_n, coalesce(k_n, avg(k_n) OVER ()) AS k_n FROM nulled)"""
AUTO_SQL = f"""WITH {NULLED}, {AUTO} SELECT event_id, {r('value_n')} AS value_n, {r('user_n')} AS user_n, type_n, {r('k_n')} AS k_n FROM c"""


@query("auto_clean", AUTO_SQL)
def auto_clean(spark, sf):
    return round_doubles(impute.auto_clean(blanks(spark, sf), ["event_id"]))


@query("auto_clean_aggressive", AUTO_SQL)
def auto_clean_aggressive(spark, sf):
    return round_doubles(impute.auto_clean(blanks(spark, sf), ["event_id"], strategy="aggressive"))


@query("imputation_comparison", f"""WITH {NULLED}, {AUTO},
  b AS (SELECT count(value_n) AS n, avg(value_n) AS m, stddev_samp(value_n) AS s, min(value_n) AS mn, quantile_cont(value_n, [0.25, 0.5, 0.75]) AS q,
    max(value_n) AS mx, 100.0 * (count(*) - count(value_n)) / count(*) AS p FROM nulled),
  a AS (SELECT count(value_n) AS n, avg(value_n) AS m, stddev_samp(value_n) AS s, min(value_n) AS mn, quantile_cont(value_n, [0.25, 0.5, 0.75]) AS q,
    max(value_n) AS mx, 100.0 * (count(*) - count(value_n)) / count(*) AS p FROM c)""" + " UNION ALL ".join(
    f"""SELECT 'value_n' AS "column", '{name}' AS statistic, {r('b.' + e)} AS before, {r('a.' + e)} AS after, {r(f'a.{e} - b.{e}')} AS difference
    FROM a, b""" for name, e in (("count", "n"), ("mean", "m"), ("std", "s"), ("min", "mn"), ("25%", "q[1]"), ("50%", "q[2]"),
                                 ("75%", "q[3]"), ("max", "mx"), ("missing_pct", "p"))))
def imputation_comparison(spark, sf):
    before = blanks(spark, sf).select("event_id", "value_n")
    return round_doubles(impute.imputation_comparison(before, impute.impute_mean(before, ["value_n"]), ["value_n"]))


def _dedup_sql(condition: str, order: str = "event_id") -> str:
    return f"""SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type
      ORDER BY {order}) AS rn, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events) WHERE {condition}"""


def _visits(spark, sf):
    return load_table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")


@query("drop_duplicates", _dedup_sql("rn = 1"))
def drop_duplicates(spark, sf):
    return impute.drop_duplicates(_visits(spark, sf), ["event_id"], ["user_id", "event_type"])


@query("drop_duplicates_last", _dedup_sql("rn = 1", "event_id DESC"))
def drop_duplicates_last(spark, sf):
    return impute.drop_duplicates(_visits(spark, sf), ["event_id"], ["user_id", "event_type"], "last")


@query("drop_duplicates_none", """SELECT o_orderkey, o_custkey, o_orderpriority FROM (SELECT *, count(*) OVER (
  PARTITION BY o_custkey, o_orderpriority) AS n FROM orders) WHERE n = 1""")
def drop_duplicates_none(spark, sf):
    return impute.drop_duplicates(load_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"),
                                  ["o_orderkey"], ["o_custkey", "o_orderpriority"], False)


@query("duplicate_value_report", f"""WITH a AS ({_dedup_sql('rn = 1')}), x AS (SELECT user_id AS v, count(*) AS n FROM events GROUP BY 1),
  y AS (SELECT user_id AS v, count(*) AS n FROM a GROUP BY 1)
  SELECT x.v AS value, x.n AS before, y.n AS after, x.n - y.n AS removed FROM x LEFT JOIN y ON x.v = y.v
  WHERE x.n - y.n > 0 ORDER BY removed DESC, value LIMIT 10""")
def duplicate_value_report(spark, sf):
    before = _visits(spark, sf)
    return impute.duplicate_value_report(before, impute.drop_duplicates(before, ["event_id"], ["user_id", "event_type"]), "user_id")


# outliers -----------------------------------------------------------------------------------------------------------

FENCES = """f AS (SELECT quantile_cont(value_n, 0.25) - 1.5 * (quantile_cont(value_n, 0.75) - quantile_cont(value_n, 0.25)) AS lo,
  quantile_cont(value_n, 0.75) + 1.5 * (quantile_cont(value_n, 0.75) - quantile_cont(value_n, 0.25)) AS hi FROM nulled)"""


def _values(spark, sf):
    return blanks(spark, sf).select("event_id", "value_n")


@query("outlier_iqr", f"""WITH {NULLED}, {FENCES} SELECT event_id, value_n, coalesce(value_n < lo OR value_n > hi, false)::INT AS is_outlier
  FROM nulled, f""")
def outlier_iqr(spark, sf):
    return outliers.outlier_iqr(_values(spark, sf), "value_n")


@query("outlier_mean_std", f"""WITH {NULLED}, f AS (SELECT avg(value_n) AS m, stddev_samp(value_n) AS s FROM nulled)
  SELECT event_id, value_n, coalesce(value_n < m - 3 * s OR value_n > m + 3 * s, false)::INT AS is_outlier FROM nulled, f""")
def outlier_mean_std(spark, sf):
    return outliers.outlier_mean_std(_values(spark, sf), "value_n")


MAD = """md AS (SELECT quantile_cont(value_n, 0.5) AS m FROM nulled), mad AS (SELECT quantile_cont(abs(value_n - m), 0.5) AS d FROM nulled, md)"""


@query("outlier_mad", f"""WITH {NULLED}, {MAD} SELECT event_id, value_n, coalesce(abs(0.6745 * (value_n - m) / d) > 3.5, false)::INT AS is_outlier
  FROM nulled, md, mad""")
def outlier_mad(spark, sf):
    return outliers.outlier_mad(_values(spark, sf), "value_n")


def _winsor_sql(strategy: str) -> str:
    top = "WHEN value_n > hi THEN hi" if strategy != "bottom" else ""
    bottom = "WHEN value_n < lo THEN lo" if strategy != "top" else ""
    return f"WITH {NULLED}, {FENCES} SELECT event_id, {r(f'CASE {top} {bottom} ELSE value_n END')} AS value_n FROM nulled, f"


@query("winsorize", _winsor_sql("both"))
def winsorize(spark, sf):
    return round_doubles(outliers.winsorize(_values(spark, sf), "value_n"))


@query("winsorize_top", _winsor_sql("top"))
def winsorize_top(spark, sf):
    return round_doubles(outliers.winsorize(_values(spark, sf), "value_n", "top"))


@query("winsorize_bottom", _winsor_sql("bottom"))
def winsorize_bottom(spark, sf):
    return round_doubles(outliers.winsorize(_values(spark, sf), "value_n", "bottom"))


@query("drop_outliers", f"WITH {NULLED}, {FENCES} SELECT event_id, value_n FROM nulled, f WHERE NOT coalesce(value_n < lo OR value_n > hi, false)")
def drop_outliers(spark, sf):
    return outliers.drop_outliers(_values(spark, sf), "value_n")


@query("outlier_summary", f"""WITH {NULLED}, {FENCES}, g AS (SELECT avg(value_n) AS a, stddev_samp(value_n) AS s FROM nulled), {MAD},
  t AS (SELECT 'iqr' AS method, count(*) FILTER (value_n < lo OR value_n > hi) AS outliers, count(*) AS n FROM nulled, f
    UNION ALL SELECT 'mean_std', count(*) FILTER (value_n < a - 3 * s OR value_n > a + 3 * s), count(*) FROM nulled, g
    UNION ALL SELECT 'mad', count(*) FILTER (abs(0.6745 * (value_n - m) / d) > 3.5), count(*) FROM nulled, md, mad)
  SELECT method, outliers, {r('outliers / n')} AS share, (outliers / n > 0.05)::INT AS warn FROM t""")
def outlier_summary(spark, sf):
    return round_doubles(outliers.outlier_summary(_values(spark, sf), "value_n"))


