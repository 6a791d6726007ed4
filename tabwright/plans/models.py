"""Models on the sample tables: fitted on the training part, judged on the rest."""

from __future__ import annotations

from math import ceil

from pyspark.sql import functions as F

from tabwright.functions.columns import round_doubles
from tabwright.functions.texts import count_texts
from tabwright.operators.impute import impute_mean
from tabwright.operators.models import boost, classify, regress, stack
from tabwright.operators.models.recipe import Task, train_classifier, train_regressor
from tabwright.operators.project import coerce_numeric
from tabwright.plans.neighbours import VECTOR, vectors
from tabwright.plans.registry import query, r
from tabwright.session import scratch_path
from tabwright.sources import load_model, load_table, save_model
from tabwright.streaming import score

TEXT_FEATURES = ["words", "lines", "digits", "capitals", "stops", "word_length"]


ROWS_PER_TASK = 20_000  # counted texts


def texts(spark, sf):
    """(doc_id, quality, n_chars and simple counts over the whole text) of the labelled documents.

    A file is read by as many tasks as it has row groups; the counts are dealt out again where those are few for the rows.
    """
    d = load_table(spark, sf, "documents")
    counted = count_texts(d.select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), "text"))
    tasks = ceil(d.count() / ROWS_PER_TASK)
    if tasks > counted.rdd.getNumPartitions():
        counted = counted.repartition(tasks, "doc_id")
    return counted.withColumn("word_length", F.col("n_chars") / F.col("words"))


def judged_texts(spark, sf):
    return texts(spark, sf).join(load_table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


def lines(spark, sf):
    """Line items with a row key."""
    t = load_table(spark, sf, "lineitem")
    return t.withColumn("line_key", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))


CLASSES = Task("vec_id", tuple(VECTOR), "label")
QUALITY = Task("doc_id", ("n_chars", *TEXT_FEATURES), "quality")
PRICE = Task("line_key", ("l_quantity", "l_discount", "l_tax"), "l_extendedprice")
LENGTH = Task("doc_id", tuple(TEXT_FEATURES), "n_chars")

CLASSIFIERS = {
    "clf_logistic": (vectors, CLASSES, lambda: classify.logistic()),
    "clf_random_forest": (vectors, CLASSES, lambda: classify.random_forest()),
    "clf_decision_tree": (vectors, CLASSES, lambda: classify.decision_tree()),
    "clf_svm": (vectors, CLASSES, lambda: classify.svm()),
    "clf_svm_rbf": (judged_texts, QUALITY, lambda: classify.svm(kernel="rbf")),
    "clf_svm_poly": (judged_texts, QUALITY, lambda: classify.svm(kernel="poly")),
    "clf_gradient_boosting": (judged_texts, QUALITY, lambda: classify.gradient_boosting()),
    "clf_adaboost": (judged_texts, QUALITY, lambda: boost.adaboost_classifier()),
    "clf_adaboost_classes": (vectors, CLASSES, lambda: boost.adaboost_classifier(depth=3)),
    "clf_stacking": (judged_texts, QUALITY, lambda: stack.stack_classifiers()),
}
REGRESSORS = {
    "reg_linear_all": (lines, PRICE, lambda: regress.linear()),
    "reg_ridge": (lines, PRICE, lambda: regress.ridge()),
    "reg_lasso": (lines, PRICE, lambda: regress.lasso()),
    "reg_decision_tree": (lines, PRICE, lambda: regress.decision_tree()),
    "reg_random_forest": (lines, PRICE, lambda: regress.random_forest()),
    "reg_gradient_boosting": (lines, PRICE, lambda: regress.gradient_boosting()),
    "reg_xgboost": (lines, PRICE, lambda: regress.boosted_trees()),
    "reg_svr": (texts, LENGTH, lambda: regress.svr(kernel="rbf")),
    "reg_svr_linear": (texts, LENGTH, lambda: regress.svr(kernel="linear")),
    "reg_extra_trees": (texts, LENGTH, lambda: regress.extra_trees()),
    "reg_adaboost": (texts, LENGTH, lambda: boost.adaboost_regressor()),
    "reg_stacking": (texts, LENGTH, lambda: stack.stack_regressors()),
}


def _register(name, table, task, make, train):
    @query(name)
    def report(spark, sf):
        return train(table(spark, sf), task, make()).report


for _name, (_table, _task, _make) in CLASSIFIERS.items():
    _register(_name, _table, _task, _make, train_classifier)
for _name, (_table, _task, _make) in REGRESSORS.items():
    _register(_name, _table, _task, _make, train_regressor)


@query("clf_balanced")
def clf_balanced(spark, sf):
    return train_classifier(judged_texts(spark, sf), QUALITY, classify.logistic(), balance=True).report


@query("clf_xgboost")
def clf_xgboost(spark, sf):
    """Text columns to numbers, gaps to the mean, then boosted trees."""
    t = judged_texts(spark, sf).withColumn("words", F.when(F.col("words") > 10, F.col("words").cast("string")).otherwise("few"))
    t = coerce_numeric(t, "words")
    return train_classifier(impute_mean(t, QUALITY.features), QUALITY, classify.gradient_boosting()).report


HELD = "('0x' || substr(md5(concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) || ':42'), 1, 7))::BIGINT % 1000 < 200"


@query("reg_linear", f"""WITH s AS (SELECT l_quantity AS x, l_extendedprice AS y, {HELD} AS held FROM lineitem),
  m AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM s WHERE NOT held),
  t AS (SELECT y, a * x + b AS f FROM s, m WHERE held)
  SELECT {r('1 - avg((y - f) * (y - f)) / var_pop(y)')} AS r2, {r('avg(abs(y - f))', 3)} AS mae, {r('avg((y - f) * (y - f))', 0)} AS mse FROM t""")
def reg_linear(spark, sf):
    task = Task("line_key", ("l_quantity",), "l_extendedprice")
    return round_doubles(train_regressor(lines(spark, sf), task, regress.linear()).report, mae=3, mse=0)


@query("model_save")
def model_save(spark, sf):
    fitted = train_regressor(texts(spark, sf), LENGTH, regress.ridge())
    path = scratch_path(spark, "model")
    save_model(fitted.model, path)
    return spark.read.json(f"{path}/metadata").select("class", "sparkVersion")


@query("model_load")
def model_load(spark, sf):
    table = texts(spark, sf)
    fitted = train_regressor(table, LENGTH, regress.ridge())
    path = scratch_path(spark, "model")
    save_model(fitted.model, path)
    return score.batch_score(load_model(path), table).select("doc_id", "n_chars", "prediction")


@query("batch_score")
def batch_score(spark, sf):
    fitted = train_classifier(judged_texts(spark, sf), QUALITY, classify.logistic())
    return score.batch_score(fitted.model, texts(spark, sf)).select("doc_id", "prediction")
