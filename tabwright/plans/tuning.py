"""Hyper-parameter search on the sample tables, over the whole default spaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.functions.columns import round_doubles
from tabwright.operators.models import search
from tabwright.operators.models.search import TUNERS, choice, log_real, real, whole
from tabwright.plans.models import LENGTH, QUALITY, judged_texts, texts
from tabwright.plans.registry import query, r
from tabwright.sources import load_table

# As many trials and folds as the original's searches.
TRIAL_COUNT, FOLDS = 30, 5


def run(name, spark, sf, trials=TRIAL_COUNT, k=FOLDS):
    tuner = TUNERS[name]
    table, task = (judged_texts(spark, sf), QUALITY) if tuner.classify else (texts(spark, sf), LENGTH)
    return search.search(table, task, tuner, trials=trials, k=k)


def _register(name):
    @query(name)
    def tune(spark, sf):
        return run(name, spark, sf).trials


for _name in TUNERS:
    _register(_name)


@query("search_space_sampler")
def search_space_sampler(spark, sf):
    space = {"a": choice("x", "y"), "b": whole(2, 20, 2), "c": real(0.5, 1.0, 0.1), "d": log_real(0.01, 10)}
    draws = search.search_space_table(spark, space, 20)
    # the batch of rows each trial would train on first, by its own random fold
    docs = load_table(spark, sf, "labels").select(F.pmod(F.xxhash64("doc_id"), F.lit(20)).cast("int").alias("trial"))
    return draws.join(docs.groupBy("trial").agg(F.count("*").alias("rows")), "trial", "left")


# A trial table computed from data: each brand is a trial, its settings are statistics of its parts.
TRIALS = """trials AS (SELECT (row_number() OVER (ORDER BY p_brand) - 1)::INT AS trial, round(avg(p_retailprice), 4) AS value,
  count(*) AS n, max(p_size) AS size FROM part GROUP BY p_brand)"""


def brand_trials(spark, sf):
    stats = load_table(spark, sf, "part").groupBy("p_brand").agg(
        F.round(F.avg("p_retailprice"), 4).alias("value"), F.count("*").alias("n"), F.max("p_size").alias("size"),
        F.round(F.avg("p_size"), 3).alias("mean"))
    rank = stats.select("p_brand").orderBy("p_brand")
    numbered = spark.createDataFrame([(i, row[0]) for i, row in enumerate(rank.collect())], "trial int, p_brand string")  # brands
    return numbered.join(stats, "p_brand").select(
        "trial", "value", F.to_json(F.struct("n", "size", "mean")).alias("params"), "n", "size")


@query("trial_table", f"WITH {TRIALS} SELECT trial, value, n, size FROM trials")
def trial_table(spark, sf):
    return search.ranked_trials(brand_trials(spark, sf)).select("trial", "value", "n", "size")


@query("best_trial", f"WITH {TRIALS} SELECT trial, value FROM trials ORDER BY value DESC, trial LIMIT 1")
def best_trial(spark, sf):
    return search.best_trial(brand_trials(spark, sf)).select("trial", "value")


@query("optimization_history", f"""WITH {TRIALS} SELECT trial, {r('value', 4)} AS value,
  {r('max(value) OVER (ORDER BY trial)', 4)} AS best_so_far FROM trials""")
def optimization_history(spark, sf):
    return round_doubles(search.optimization_history(brand_trials(spark, sf).select("trial", "value")), 4)


@query("param_importance")
def param_importance(spark, sf):
    return search.param_importance(brand_trials(spark, sf).select("trial", "value", "params"))


@query("parallel_coordinates", f"""WITH {TRIALS} SELECT trial, value, 'n' AS parameter, CAST(n AS VARCHAR) AS setting FROM trials
  UNION ALL SELECT trial, value, 'size', CAST(size AS VARCHAR) FROM trials""")
def parallel_coordinates(spark, sf):
    t = search.parallel_coordinates(brand_trials(spark, sf).select("trial", "value", "params"))
    return t.where(F.col("parameter") != "mean")


@query("contour_table")
def contour_table(spark, sf):
    return search.contour_table(brand_trials(spark, sf).select("trial", "value", "params"))
