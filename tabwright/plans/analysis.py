"""Tables behind charts."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tabwright.functions.columns import round_doubles
from tabwright.operators import analyze
from tabwright.plans.cleaning import box_sql
from tabwright.plans.profiling import describe_sql
from tabwright.plans.registry import LINE_NUMBERS, NULLED, blanks, query, r
from tabwright.sources import load_table


@query("line_series", """SELECT l_shipdate, 'l_quantity' AS series, l_quantity AS y FROM lineitem
  UNION ALL SELECT l_shipdate, 'l_discount', l_discount FROM lineitem""")
def line_series(spark, sf):
    return analyze.line_series(load_table(spark, sf, "lineitem"), "l_shipdate", ["l_quantity", "l_discount"])


@query("box_stats", f"WITH {box_sql('value', 'event_type', 'events')}")
def box_stats(spark, sf):
    return round_doubles(analyze.box_stats(load_table(spark, sf, "events"), "value", ["event_type"]))


@query("pie_counts", f"""WITH c AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL)
  SELECT l_returnflag, l_linestatus, n, {r('n / sum(n) OVER (PARTITION BY l_returnflag)')} AS share FROM c""")
def pie_counts(spark, sf):
    return round_doubles(analyze.pie_counts(load_table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus"))


@query("scatter_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS x_column, '{b}' AS y_column, {a}::DOUBLE AS x, {b}::DOUBLE AS y FROM part"
    for a in ("p_size", "p_retailprice") for b in ("p_size", "p_retailprice") if a != b))
def scatter_matrix(spark, sf):
    return analyze.scatter_matrix(load_table(spark, sf, "part"), ["p_size", "p_retailprice"], ["p_partkey"])


@query("crosstab_counts", """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O",
  count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY o_orderpriority""")
def crosstab_counts(spark, sf):
    return analyze.crosstab_counts(load_table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("bar_values", """SELECT c_mktsegment, round(sum(c_acctbal), 2) AS sum, round(avg(c_acctbal), 2) AS mean, min(c_acctbal) AS min,
  max(c_acctbal) AS max, count(c_acctbal) AS count FROM customer GROUP BY c_mktsegment""")
def bar_values(spark, sf):
    return round_doubles(analyze.bar_values(load_table(spark, sf, "customer"), "c_mktsegment", "c_acctbal"), 2)


@query("count_values", f"WITH {NULLED} SELECT type_n AS value, count(*) AS n FROM nulled WHERE type_n IS NOT NULL GROUP BY type_n")
def count_values(spark, sf):
    return analyze.count_values(blanks(spark, sf), "type_n")


def _histogram_sql(column: str, table: str, bins: int = 10) -> str:
    return f"""SELECT '{column}' AS "column", b::INT AS bin, {r('lo + b * w')} AS "left", {r('lo + (b + 1) * w')} AS "right",
      coalesce(k, 0) AS n, {r('coalesce(k, 0) / (total * w)', 9)} AS density
      FROM (SELECT unnest(range(0, {bins})) AS b) bins
      CROSS JOIN (SELECT min({column}) AS lo, (max({column}) - min({column})) / {bins} AS w, count({column}) AS total FROM {table}) e
      LEFT JOIN (SELECT least(floor(({column} - mn) / wd), {bins - 1})::INT AS bb, count(*) AS k FROM {table},
        (SELECT min({column}) AS mn, (max({column}) - min({column})) / {bins} AS wd FROM {table}) WHERE {column} IS NOT NULL GROUP BY 1)
      ON b = bb"""


@query("histogram_density", f"WITH {NULLED} " + _histogram_sql("value_n", "nulled", 20))
def histogram_density(spark, sf):
    return round_doubles(analyze.histogram_density(blanks(spark, sf), ["value_n"], 20), density=9)


@query("kernel_density", f"""WITH s AS (SELECT count(*) AS n, stddev_samp(value) * pow(count(*), -0.2) AS h, min(value) AS lo, max(value) AS hi FROM events),
  c AS (SELECT value AS v, count(*) AS k FROM events GROUP BY value), g AS (SELECT lo + (hi - lo) * unnest(range(0, 200)) / 199.0 AS x, n, h FROM s)
  SELECT {r('x')} AS x, {r('sum(k * exp(-0.5 * pow((x - v) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi()))', 9)} AS density
  FROM g, c GROUP BY x""")
def kernel_density(spark, sf):
    return round_doubles(analyze.kernel_density(load_table(spark, sf, "events"), "value"), density=9)


@query("scatter_points", "SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem")
def scatter_points(spark, sf):
    return analyze.scatter_points(load_table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@query("scatter_3d", "SELECT l_quantity AS x, l_extendedprice AS y, l_linenumber::DOUBLE AS z FROM lineitem")
def scatter_3d(spark, sf):
    return analyze.scatter_3d(load_table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_linenumber")


@query("correlation_pairs", f"WITH {NULLED} " + " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, {r(f'corr({a}, {b})')} AS correlation FROM nulled"
    for a, b in combinations(("value_n", "user_n", "k_n"), 2)))
def correlation_pairs(spark, sf):
    return round_doubles(analyze.correlation_pairs(blanks(spark, sf), ["value_n", "user_n", "k_n"]))


@query("correlation_matrix", " UNION ALL ".join(
    f"""SELECT '{a}' AS "column", """ + ", ".join(r(f"corr({a}, {b})", 2) + f" AS {b}" for b in LINE_NUMBERS) + " FROM lineitem"
    for a in LINE_NUMBERS))
def correlation_matrix(spark, sf):
    return round_doubles(analyze.correlation_matrix(load_table(spark, sf, "lineitem"), LINE_NUMBERS), 2)


@query("top_correlations", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, {r(f'corr({a}, {b})')} AS correlation FROM lineitem"
    for a, b in combinations(LINE_NUMBERS, 2)) + ") ORDER BY abs(correlation) DESC, column_a, column_b LIMIT 3")
def top_correlations(spark, sf):
    return round_doubles(analyze.top_correlations(load_table(spark, sf, "lineitem"), LINE_NUMBERS, 3))


def _resample_sql(table: str, time: str, value: str, interval: str, how: str, places: int = 6) -> str:
    unit, step = {"D": ("day", "1 DAY"), "W": ("week", "7 DAYS"), "M": ("month", "1 MONTH"), "Q": ("quarter", "3 MONTHS"),
                  "Y": ("year", "1 YEAR")}[interval]
    label = {"D": "s", "W": "s + INTERVAL 6 DAYS", "M": "last_day(s)", "Q": "last_day(s + INTERVAL 2 MONTHS)",
             "Y": "last_day(s + INTERVAL 11 MONTHS)"}[interval]
    agg = {"mean": "avg"}.get(how, how)
    filled = "coalesce(v, 0)" if how in ("sum", "count") else "v"
    shown = filled if how == "count" else r(filled, places)
    return f"""b AS (SELECT CAST(date_trunc('{unit}', {time}) AS DATE) AS s0, {agg}({value}) AS v FROM {table} GROUP BY 1),
      c AS (SELECT CAST(unnest(generate_series(CAST((SELECT min(s0) FROM b) AS TIMESTAMP), CAST((SELECT max(s0) FROM b) AS TIMESTAMP), INTERVAL {step})) AS DATE) AS s),
      z AS (SELECT CAST({label} AS DATE) AS bin, {shown} AS value FROM c LEFT JOIN b ON s = s0)"""


@query("time_resample", "WITH " + _resample_sql("events", "ts", "value", "D", "mean") + " SELECT * FROM z")
def time_resample(spark, sf):
    return round_doubles(analyze.time_resample(load_table(spark, sf, "events"), "ts", "value", "D", "mean"))


@query("time_resample_week", "WITH " + _resample_sql("events", "ts", "value", "W", "count") + " SELECT * FROM z")
def time_resample_week(spark, sf):
    return analyze.time_resample(load_table(spark, sf, "events"), "ts", "value", "W", "count")


@query("time_resample_month", "WITH " + _resample_sql("orders", "o_orderdate", "o_totalprice", "M", "sum", 2) + " SELECT * FROM z")
def time_resample_month(spark, sf):
    return round_doubles(analyze.time_resample(load_table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "M", "sum"), 2)


@query("time_resample_quarter", "WITH " + _resample_sql("orders", "o_orderdate", "o_totalprice", "Q", "max") + " SELECT * FROM z")
def time_resample_quarter(spark, sf):
    return round_doubles(analyze.time_resample(load_table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "Q", "max"))


@query("time_resample_year", "WITH " + _resample_sql("orders", "o_orderdate", "o_totalprice", "Y", "min") + " SELECT * FROM z")
def time_resample_year(spark, sf):
    return round_doubles(analyze.time_resample(load_table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "Y", "min"))


@query("rolling_mean_7", "WITH " + _resample_sql("events", "ts", "value", "D", "mean") + f""" SELECT bin, value,
  CASE WHEN count(value) OVER w = 7 THEN {r('avg(value) OVER w', 4)} END AS rolling FROM z
  WINDOW w AS (ORDER BY bin ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def rolling_mean_7(spark, sf):
    bins = analyze.time_resample(load_table(spark, sf, "events"), "ts", "value", "D", "mean")
    return round_doubles(analyze.rolling_mean_7(bins), rolling=4)


@query("distribution_compare", _histogram_sql("l_quantity", "lineitem") + " UNION ALL " + _histogram_sql("l_extendedprice", "lineitem"))
def distribution_compare(spark, sf):
    return round_doubles(analyze.distribution_compare(load_table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"]), density=9)


def _cohort_sql(value: str, places: int) -> str:
    return f"""WITH m AS (SELECT o_custkey AS u, CAST(date_trunc('month', o_orderdate) AS DATE) AS mo, o_totalprice AS v FROM orders),
      f AS (SELECT u, min(mo) AS cohort FROM m GROUP BY u),
      c AS (SELECT cohort, ((year(mo) - year(cohort)) * 12 + month(mo) - month(cohort))::INT AS cohort_index, avg(v) AS mean_value,
        count(DISTINCT m.u) AS users FROM m JOIN f ON m.u = f.u GROUP BY ALL)
      SELECT c.cohort, c.cohort_index, {r('c.mean_value')} AS mean_value, c.users, {r(f'c.{value} / b.{value}', places)} AS retention
      FROM c LEFT JOIN c b ON b.cohort = c.cohort AND b.cohort_index = 0"""


@query("cohort_retention", _cohort_sql("mean_value", 6))
def cohort_retention(spark, sf):
    return round_doubles(analyze.cohort_retention(load_table(spark, sf, "orders"), "o_orderdate", "o_custkey", "o_totalprice"))


@query("cohort_retention_users", _cohort_sql("users", 6))
def cohort_retention_users(spark, sf):
    return round_doubles(analyze.cohort_retention(load_table(spark, sf, "orders"), "o_orderdate", "o_custkey", "o_totalprice", "users"))


@query("funnel", f"""WITH s AS (SELECT count(*) FILTER (value >= 5)::DOUBLE AS a, count(*) FILTER (value >= 50)::DOUBLE AS b,
    count(*) FILTER (value >= 150)::DOUBLE AS c, count(*) AS n FROM events)
  SELECT 0 AS position, 'seen' AS stage, a AS count, {r('a / n * 100')} AS percentage, NULL::DOUBLE AS conversion FROM s
  UNION ALL SELECT 1, 'engaged', b, {r('b / n * 100')}, {r('b / a * 100')} FROM s
  UNION ALL SELECT 2, 'bought', c, {r('c / n * 100')}, {r('c / b * 100')} FROM s""")
def funnel(spark, sf):
    stages = load_table(spark, sf, "events").select(*[
        (F.col("value") >= limit).cast("int").alias(name) for name, limit in (("seen", 5), ("engaged", 50), ("bought", 150))])
    return round_doubles(analyze.funnel(stages, ["seen", "engaged", "bought"]))


@query("segment_kmeans")
def segment_kmeans(spark, sf):
    t = load_table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return analyze.segment_kmeans(t, ["c_acctbal", "c_nationkey"])


@query("cluster_stats", " UNION ALL ".join(describe_sql(c, "lineitem", "l_returnflag") for c in LINE_NUMBERS))
def cluster_stats(spark, sf):
    return round_doubles(analyze.cluster_stats(load_table(spark, sf, "lineitem"), LINE_NUMBERS, "l_returnflag"))


@query("sort_rows", "SELECT p_partkey, p_name, p_retailprice FROM part")
def sort_rows(spark, sf):
    return analyze.sort_rows(load_table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice"), ["p_retailprice", "p_partkey"], False)


@query("group_mean_count", f"SELECT p_brand, {r('avg(p_retailprice)', 4)} AS mean, count(*) AS n FROM part GROUP BY p_brand")
def group_mean_count(spark, sf):
    return round_doubles(analyze.group_mean_count(load_table(spark, sf, "part"), "p_brand", "p_retailprice"), 4)


@query("top10_values", "SELECT p_brand AS value, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, value LIMIT 10")
def top10_values(spark, sf):
    return analyze.top10_values(load_table(spark, sf, "part"), "p_brand")
