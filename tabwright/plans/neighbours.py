"""Operators built on nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.functions.columns import quoted, round_doubles
from tabwright.operators import impute, neighbors
from tabwright.operators.split import split_tables
from tabwright.plans.cleaning import mode_sql
from tabwright.plans.registry import NULLED, blanks, query, r
from tabwright.sources import load_table

DIMENSIONS = 64
VECTOR = [f"f{i}" for i in range(DIMENSIONS)]


def vectors(spark, sf):
    """(vec_id, label, f0..f63)."""
    e = load_table(spark, sf, "embeddings")
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(VECTOR)])


def significant(x: str, digits: int = 12) -> str:
    """Ties to so many significant digits, whatever the scale."""
    unit = f"pow(10.0, {digits} - ceil(log10({x})))"
    return f"(CASE WHEN {x} > 1e-280 THEN round({x} * {unit}) / {unit} ELSE {x} END)"


def _knn_impute_sql(columns: list[str], k: int, key: str = "event_id") -> str:
    shared = " + ".join(f"(q.{c} IS NOT NULL AND d.{c} IS NOT NULL)::INT" for c in columns)
    squares = " + ".join(f"coalesce((q.{c} - d.{c}) * (q.{c} - d.{c}), 0)" for c in columns)
    parts = []
    for c in columns:
        parts.append(f"""n_{c} AS (SELECT {key}, avg(x) AS x FROM (SELECT q.{key}, d.{c} AS x, row_number() OVER (PARTITION BY q.{key}
          ORDER BY {significant(f'(({squares}) * {len(columns)}.0 / ({shared}))')}, d.{key}) AS rn
          FROM nulled q JOIN nulled d ON q.{c} IS NULL AND d.{c} IS NOT NULL AND ({shared}) > 0) WHERE rn <= {k} GROUP BY {key})""")
    return ", ".join(parts)


def _knn_filled(c: str) -> str:
    return r(f"coalesce(nulled.{c}, n_{c}.x, (SELECT avg({c}) FROM nulled))")


PAIR = ["value_n", "k_n"]


@query("impute_knn", f"""WITH {NULLED}, {_knn_impute_sql(PAIR, 5)} SELECT event_id, {', '.join(f'{_knn_filled(c)} AS {c}' for c in PAIR)}
  FROM nulled {' '.join(f'LEFT JOIN n_{c} USING (event_id)' for c in PAIR)}""")
def impute_knn(spark, sf):
    return round_doubles(neighbors.impute_knn(blanks(spark, sf).select("event_id", *PAIR), PAIR, "event_id"))


DOZEN = VECTOR[:12]
GAP = "({k} * 31 + {i} * 7) % 97 = 0 OR ({k} + {i}) % 409 < 3"  # single gaps, and rows with several


@query("impute_knn_wide", f"""WITH nulled AS (SELECT vec_id, {', '.join(
    f"CASE WHEN NOT ({GAP.format(k='vec_id', i=i)}) THEN embedding[{i + 1}]::DOUBLE END AS {c}" for i, c in enumerate(DOZEN))} FROM embeddings),
  {_knn_impute_sql(DOZEN, 5, 'vec_id')} SELECT vec_id, {', '.join(f'{_knn_filled(c)} AS {c}' for c in DOZEN)}
  FROM nulled {' '.join(f'LEFT JOIN n_{c} USING (vec_id)' for c in DOZEN)}""")
def impute_knn_wide(spark, sf):
    gaps = [F.when(~F.expr(GAP.format(k="vec_id", i=i)), F.col(c)).alias(c) for i, c in enumerate(DOZEN)]
    return round_doubles(neighbors.impute_knn(vectors(spark, sf).select("vec_id", *gaps), DOZEN, "vec_id"))


TRIO = ["value_n", "user_n", "k_n"]


@query("auto_clean_conservative", f"""WITH {NULLED}, {_knn_impute_sql(TRIO, 5)} SELECT event_id, {', '.join(f'{_knn_filled(c)} AS {c}' for c in TRIO)},
  coalesce(type_n, {mode_sql('type_n')}) AS type_n FROM nulled {' '.join(f'LEFT JOIN n_{c} USING (event_id)' for c in TRIO)}""")
def auto_clean_conservative(spark, sf):
    return round_doubles(impute.auto_clean(blanks(spark, sf), ["event_id"], strategy="conservative"))


LOF = f"""p AS (SELECT vec_id, embedding::DOUBLE[64] AS v FROM embeddings),
  d AS (SELECT a.vec_id AS q, b.vec_id AS o, array_distance(a.v, b.v) AS dist FROM p a JOIN p b ON a.vec_id <> b.vec_id),
  n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY {significant('(dist * dist)')}, o) AS rn FROM d) WHERE rn <= 20),
  k AS (SELECT q AS o, max(dist) AS kd FROM n GROUP BY q),
  l AS (SELECT q, 1 / (avg(greatest(kd, dist)) + 1e-10) AS lrd FROM n JOIN k USING (o) GROUP BY q),
  s AS (SELECT n.q AS vec_id, avg(b.lrd) / any_value(a.lrd) AS score FROM n JOIN l b ON n.o = b.q JOIN l a ON n.q = a.q GROUP BY n.q)"""


@query("outlier_lof", f"""WITH {LOF} SELECT vec_id, {r('score')} AS score,
  (-score < (SELECT quantile_cont(-score, 0.1) FROM s))::INT AS is_outlier FROM s""")
def outlier_lof(spark, sf):
    return round_doubles(neighbors.outlier_lof(vectors(spark, sf), "vec_id", VECTOR).select("vec_id", "score", "is_outlier"))


@query("outlier_lof_top", f"WITH {LOF} SELECT vec_id, {r('score')} AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 20")
def outlier_lof_top(spark, sf):
    return round_doubles(neighbors.lof_top(neighbors.outlier_lof(vectors(spark, sf), "vec_id", VECTOR), "vec_id"))


@query("outlier_lof_events")
def outlier_lof_events(spark, sf):
    t = load_table(spark, sf, "events").select("event_id", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    return neighbors.outlier_lof(t, "event_id", ["value", "k"])


SPLIT = """s AS (SELECT vec_id, label, embedding::DOUBLE[64] AS v,
  ('0x' || substr(md5(CAST(vec_id AS VARCHAR) || ':42'), 1, 7))::BIGINT % 1000 < 200 AS held FROM embeddings)"""
NEAR = f"""n AS (SELECT * FROM (SELECT a.vec_id AS q, b.label AS label, row_number() OVER (PARTITION BY a.vec_id
  ORDER BY {significant('(array_distance(a.v, b.v) * array_distance(a.v, b.v))')}, b.vec_id) AS rn FROM s a JOIN s b ON a.held AND NOT b.held) WHERE rn <= {{k}})"""


@query("clf_knn", f"""WITH {SPLIT}, {NEAR.format(k=5)}, c AS (SELECT q, label, count(*) AS votes FROM n GROUP BY ALL)
  SELECT q AS vec_id, first(label ORDER BY votes DESC, label) AS prediction FROM c GROUP BY q""")
def clf_knn(spark, sf):
    train, test = split_tables(vectors(spark, sf), "vec_id")
    return neighbors.knn_classify(train, test, "vec_id", VECTOR, "label", 5, "none").select("vec_id", "prediction")


@query("reg_knn", f"WITH {SPLIT}, {NEAR.format(k=3)} SELECT q AS vec_id, {r('avg(label)')} AS prediction FROM n GROUP BY q")
def reg_knn(spark, sf):
    train, test = split_tables(vectors(spark, sf), "vec_id")
    return round_doubles(neighbors.knn_regress(train, test, "vec_id", VECTOR, "label", 3, "none").select("vec_id", "prediction"))


@query("smote")
def smote(spark, sf):
    return neighbors.smote(vectors(spark, sf), "vec_id", VECTOR, "label").groupBy("label", "synthetic").agg(
        F.count("*").alias("n"), *[F.avg(quoted(c)).alias(f"mean_{c}") for c in VECTOR[:4]])
