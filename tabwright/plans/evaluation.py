"""Splits and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.functions.columns import round_doubles
from tabwright.operators import evaluate
from tabwright.operators.split import train_test_split as split_rows
from tabwright.plans.registry import query, r
from tabwright.sources import load_table


@query("train_test_split", """SELECT o_orderkey, CASE WHEN ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || ':42'), 1, 7))::BIGINT % 1000 < 200
  THEN 'test' ELSE 'train' END AS split FROM orders""")
def train_test_split(spark, sf):
    return split_rows(load_table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


# A document counts as good when it is long: a prediction every engine can make.
JUDGED = """judged AS (SELECT l.doc_id, quality AS actual, (n_chars > 1000)::INT AS predicted, least(1.0, n_chars / 5000) AS score,
  CASE WHEN n_chars > 8000 THEN 2 WHEN n_chars > 1000 THEN 1 ELSE 0 END AS grade FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def judged(spark, sf):
    d = load_table(spark, sf, "labels").join(load_table(spark, sf, "documents"), "doc_id")
    n = F.col("n_chars")
    return d.select("doc_id", F.col("quality").alias("actual"), (n > 1000).cast("int").alias("predicted"),
                    F.least(F.lit(1.0), n / 5000).alias("score"), F.when(n > 8000, 2).when(n > 1000, 1).otherwise(0).alias("grade"))


@query("confusion_matrix", f"""WITH {JUDGED}, l AS (SELECT actual AS v FROM judged UNION SELECT grade FROM judged)
  SELECT CAST(a.v AS VARCHAR) AS actual, CAST(p.v AS VARCHAR) AS predicted, count(j.doc_id) AS n
  FROM l a CROSS JOIN l p LEFT JOIN judged j ON j.actual = a.v AND j.grade = p.v GROUP BY ALL""")
def confusion_matrix(spark, sf):
    return evaluate.confusion_matrix(judged(spark, sf), "actual", "grade")


@query("classification_report", f"""WITH {JUDGED}, l AS (SELECT actual AS v FROM judged UNION SELECT grade FROM judged),
  c AS (SELECT v, count(*) FILTER (actual = v) AS s, count(*) FILTER (grade = v) AS g, count(*) FILTER (actual = v AND grade = v) AS h
    FROM l CROSS JOIN judged GROUP BY v),
  m AS (SELECT v, s, h, CASE WHEN g > 0 THEN h / g ELSE 0 END AS p, CASE WHEN s > 0 THEN h / s ELSE 0 END AS rc FROM c),
  f AS (SELECT *, CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END AS f1 FROM m)
  SELECT CAST(v AS VARCHAR) AS label, {r('p')} AS precision, {r('rc')} AS recall, {r('f1')} AS f1, s AS support FROM f
  UNION ALL SELECT 'accuracy', {r('sum(h) / sum(s)')}, {r('sum(h) / sum(s)')}, {r('sum(h) / sum(s)')}, sum(s)::BIGINT FROM f
  UNION ALL SELECT 'macro avg', {r('avg(p)')}, {r('avg(rc)')}, {r('avg(f1)')}, sum(s)::BIGINT FROM f
  UNION ALL SELECT 'weighted avg', {r('sum(p * s) / sum(s)')}, {r('sum(rc * s) / sum(s)')}, {r('sum(f1 * s) / sum(s)')}, sum(s)::BIGINT FROM f""")
def classification_report(spark, sf):
    return round_doubles(evaluate.classification_report(judged(spark, sf), "actual", "grade"))


@query("accuracy", f"WITH {JUDGED} SELECT {r('avg((actual = predicted)::INT)')} AS accuracy FROM judged")
def accuracy(spark, sf):
    return round_doubles(evaluate.accuracy(judged(spark, sf), "actual", "predicted"))


@query("r2_mae", f"""WITH p AS (SELECT l_extendedprice AS y, l_quantity * 1000 AS f FROM lineitem)
  SELECT {r('1 - avg((y - f) * (y - f)) / var_pop(y)')} AS r2, {r('avg(abs(y - f))', 3)} AS mae, {r('avg((y - f) * (y - f))', 1)} AS mse FROM p""")
def r2_mae(spark, sf):
    t = load_table(spark, sf, "lineitem").select("l_extendedprice", (F.col("l_quantity") * 1000).alias("guess"))
    return round_doubles(evaluate.r2_mae(t, "l_extendedprice", "guess"), mae=3, mse=1)


@query("cv_scorers", f"""WITH {JUDGED}, k AS (SELECT actual, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM judged),
  a AS (SELECT (sum(rk) FILTER (actual = 1) - count(*) FILTER (actual = 1) * (count(*) FILTER (actual = 1) + 1) / 2.0)
    / (count(*) FILTER (actual = 1) * count(*) FILTER (actual = 0)) AS auc FROM k),
  s AS (SELECT avg((actual = predicted)::INT) AS acc, count(*) FILTER (actual = 1 AND predicted = 1) AS tp, count(*) FILTER (predicted = 1) AS g,
    count(*) FILTER (actual = 1) AS p, avg(pow(actual - score, 2)) AS mse, avg(abs(actual - score)) AS mae, var_pop(actual) AS v FROM judged)
  SELECT 'accuracy' AS metric, {r('acc')} AS value FROM s UNION ALL SELECT 'precision', {r('tp / g')} FROM s
  UNION ALL SELECT 'recall', {r('tp / p')} FROM s UNION ALL SELECT 'f1', {r('2 * tp / (g + p)')} FROM s
  UNION ALL SELECT 'neg_mean_squared_error', {r('-mse')} FROM s UNION ALL SELECT 'neg_mean_absolute_error', {r('-mae')} FROM s
  UNION ALL SELECT 'r2', {r('1 - mse / v')} FROM s UNION ALL SELECT 'roc_auc', {r('auc')} FROM a""")
def cv_scorers(spark, sf):
    return round_doubles(evaluate.cv_scorers(judged(spark, sf), "actual", "predicted", "score"))


@query("softmax_top_k", f"""WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
  w AS (SELECT vec_id, i, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM u),
  p AS (SELECT vec_id, i, e / sum(e) OVER (PARTITION BY vec_id) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY e DESC, i) AS rk FROM w)
  SELECT vec_id, rk::INT AS rank, i::INT AS index, {r('p', 9)} AS probability FROM p WHERE rk <= 5""")
def softmax_top_k(spark, sf):
    return round_doubles(evaluate.softmax_top_k(load_table(spark, sf, "embeddings"), "vec_id", "embedding"), 9)


@query("confidence_filter", f"WITH {JUDGED} SELECT doc_id, {r('score')} AS score FROM judged WHERE score >= 0.5")
def confidence_filter(spark, sf):
    return round_doubles(evaluate.confidence_filter(judged(spark, sf).select("doc_id", "score"), "score"))
