"""Scalers and power transforms."""

from __future__ import annotations


from tabwright.functions.columns import round_doubles
from tabwright.operators import scale
from tabwright.plans.registry import LINE_NUMBERS, NULLED, blanks, query, r
from tabwright.sources import load_table


def _values(spark, sf):
    return blanks(spark, sf).select("event_id", "value_n")


def _orders(spark, sf):
    return load_table(spark, sf, "orders").select("o_orderkey", "o_totalprice")


@query("scale_standard", f"""WITH {NULLED} SELECT event_id, value_n, {r('(value_n - avg(value_n) OVER ()) / stddev_pop(value_n) OVER ()')}
  AS value_n_scaled FROM nulled""")
def scale_standard(spark, sf):
    return round_doubles(scale.scale_standard(_values(spark, sf), "value_n"))


@query("scale_minmax", f"""WITH {NULLED} SELECT event_id, value_n,
  {r('(value_n - min(value_n) OVER ()) / (max(value_n) OVER () - min(value_n) OVER ())')} AS value_n_minmax_scaled FROM nulled""")
def scale_minmax(spark, sf):
    return round_doubles(scale.scale_minmax(_values(spark, sf), "value_n"))


@query("scale_robust", f"""WITH {NULLED}, q AS (SELECT quantile_cont(value_n, 0.25) AS a, quantile_cont(value_n, 0.5) AS b,
  quantile_cont(value_n, 0.75) AS c FROM nulled)
  SELECT event_id, value_n, {r('(value_n - b) / (c - a)')} AS value_n_robust_scaled FROM nulled, q""")
def scale_robust(spark, sf):
    return round_doubles(scale.scale_robust(_values(spark, sf), "value_n"))


@query("normalize_l2", """SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal > 0 THEN 1.0 WHEN c_acctbal < 0 THEN -1.0 ELSE 0.0 END::DOUBLE
  AS c_acctbal_normalized FROM customer""")
def normalize_l2(spark, sf):
    return scale.normalize_l2(load_table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")


@query("log1p", f"""SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal > -1 THEN {r('ln(1 + CASE WHEN c_acctbal > -1 THEN c_acctbal END)')} END
  AS c_acctbal_log_transformed FROM customer""")
def log1p(spark, sf):
    return round_doubles(scale.log1p(load_table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal"))


@query("polynomial", f"""SELECT event_id, value, 1.0::DOUBLE AS value_poly_0, value AS value_poly_1, {r('value * value')} AS value_poly_2,
  {r('value * value * value', 4)} AS value_poly_3 FROM events""")
def polynomial(spark, sf):
    return round_doubles(scale.polynomial(load_table(spark, sf, "events").select("event_id", "value"), "value", 3), value_poly_3=4)


@query("box_cox", f"""WITH y AS (SELECT o_orderkey, o_totalprice, (pow(o_totalprice, 0.5) - 1) / 0.5 AS y FROM orders)
  SELECT o_orderkey, o_totalprice, {r('(y - avg(y) OVER ()) / stddev_pop(y) OVER ()')} AS o_totalprice_boxcox_transformed FROM y""")
def box_cox(spark, sf):
    t = _orders(spark, sf)
    return round_doubles(scale.power_with_exponent(t, "o_totalprice", "box-cox", 0.5).transform(t))


@query("box_cox_fit")
def box_cox_fit(spark, sf):
    return scale.box_cox_transform(_orders(spark, sf), "o_totalprice")


@query("yeo_johnson", f"""WITH y AS (SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal >= 0 THEN (pow(greatest(c_acctbal, 0) + 1, 0.8) - 1) / 0.8
    ELSE -(pow(1 - least(c_acctbal, 0), 1.2) - 1) / 1.2 END AS y FROM customer)
  SELECT c_custkey, c_acctbal, {r('(y - avg(y) OVER ()) / stddev_pop(y) OVER ()')} AS c_acctbal_yeojohnson_transformed FROM y""")
def yeo_johnson(spark, sf):
    t = load_table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return round_doubles(scale.power_with_exponent(t, "c_acctbal", "yeo-johnson", 0.8).transform(t))


@query("yeo_johnson_fit")
def yeo_johnson_fit(spark, sf):
    return scale.yeo_johnson_transform(load_table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")


@query("quantile_transform", f"""WITH n AS (SELECT least(1000, count(value)) AS m FROM events),
  k AS (SELECT unnest(range(0, 1000)) AS i), s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS pos, count(*) OVER () AS cnt FROM events),
  h AS (SELECT i, i / (m - 1) AS rr, (i / (m - 1)) * ((SELECT max(cnt) FROM s) - 1) AS h FROM k, n WHERE i < m),
  q AS (SELECT i, rr, a.value + (h - floor(h)) * (b.value - a.value) AS qv FROM h JOIN s a ON a.pos = floor(h)::BIGINT
    JOIN s b ON b.pos = ceil(h)::BIGINT),
  g AS (SELECT qv, min(rr) AS r_lo, max(rr) AS r_hi FROM q GROUP BY qv),
  x AS (SELECT e.event_id, e.value, lo.qv AS ql, lo.r_hi AS rl, lo.r_lo AS rl2 FROM events e ASOF JOIN g lo ON e.value >= lo.qv),
  y AS (SELECT x.*, up.qv AS qu, up.r_lo AS ru FROM x ASOF LEFT JOIN g up ON x.value <= up.qv)
  SELECT event_id, value, {r('''CASE WHEN value <= (SELECT min(qv) FROM g) THEN 0.0 WHEN value >= (SELECT max(qv) FROM g) THEN 1.0
    WHEN ql = value THEN (rl + rl2) / 2 ELSE rl + (ru - rl) * (value - ql) / (qu - ql) END''')} AS value_quantile_transformed FROM y""")
def quantile_transform(spark, sf):
    return round_doubles(scale.quantile_transform(load_table(spark, sf, "events").select("event_id", "value"), "value"))


@query("quantile_transform_normal")
def quantile_transform_normal(spark, sf):
    return scale.quantile_transform(load_table(spark, sf, "events").select("event_id", "value"), "value", "normal")


def _line(spark, sf):
    return load_table(spark, sf, "lineitem").select("l_orderkey", *LINE_NUMBERS)


@query("assemble_scale", "SELECT l_orderkey, " + ", ".join(
    f"{r(f'({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()')} AS {c}" for c in LINE_NUMBERS) + " FROM lineitem")
def assemble_scale(spark, sf):
    return round_doubles(scale.assemble_scale(_line(spark, sf), LINE_NUMBERS, "standard"))


@query("assemble_scale_minmax", "SELECT l_orderkey, " + ", ".join(
    f"{r(f'({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())')} AS {c}" for c in LINE_NUMBERS) + " FROM lineitem")
def assemble_scale_minmax(spark, sf):
    return round_doubles(scale.assemble_scale(_line(spark, sf), LINE_NUMBERS, "minmax"))


@query("assemble_scale_robust", "WITH q AS (SELECT " + ", ".join(
    f"quantile_cont({c}, [0.25, 0.5, 0.75]) AS q_{c}" for c in LINE_NUMBERS) + " FROM lineitem) SELECT l_orderkey, " + ", ".join(
    f"{r(f'({c} - q_{c}[2]) / (q_{c}[3] - q_{c}[1])')} AS {c}" for c in LINE_NUMBERS) + " FROM lineitem, q")
def assemble_scale_robust(spark, sf):
    return round_doubles(scale.assemble_scale(_line(spark, sf), LINE_NUMBERS, "robust"))


NORM = "sqrt(" + " + ".join(f"{c} * {c}" for c in LINE_NUMBERS) + ")"


@query("assemble_scale_normalizer", "SELECT l_orderkey, " + ", ".join(f"{r(f'{c} / {NORM}')} AS {c}" for c in LINE_NUMBERS) + " FROM lineitem")
def assemble_scale_normalizer(spark, sf):
    return round_doubles(scale.assemble_scale(_line(spark, sf), LINE_NUMBERS, "normalizer"))


