"""The steps common to all models: convert, split, balance, scale, fit, score."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import IndexToString, SQLTransformer, StringIndexer
from pyspark.sql import DataFrame, functions as F

from tabwright.functions.columns import as_double, none_missing, quoted
from tabwright.operators.evaluate import classification_report, r2_mae
from tabwright.operators.neighbors import smote
from tabwright.operators.scale import scaling_stages
from tabwright.operators.split import fold_of, in_share
from tabwright.operators.stats import aggregate_once
from tabwright.session import checkpointed

LABEL, PREDICTED = "_label", "prediction"
FEATURES = "features"
# from prepared training rows (``features``, ``_label`` and the key) to fitted stages that add ``_prediction``
Fit = Callable[[DataFrame, "Task"], list[Transformer]]


@dataclass(frozen=True)
class Task:
    """What to predict from what."""

    key: str
    features: tuple[str, ...]
    target: str
    scaler: str = "standard"
    test_share: float = 0.2
    seed: int = 42
    classes: int = 0  # set for classification


@dataclass(frozen=True)
class Fitted:
    """A saved-and-loaded-anywhere pipeline, its scores on the held-out rows, and those rows with predictions."""

    model: PipelineModel
    report: DataFrame
    predictions: DataFrame


def prepare(df: DataFrame, task: Task, classify: bool) -> DataFrame:
    """Key, numeric features and target of the rows that have them all."""
    target = quoted(task.target).cast("string") if classify else as_double(df, task.target)
    rows = df.select(quoted(task.key), *[as_double(df, f).alias(f) for f in task.features], target.alias(task.target))
    return rows.where(none_missing(rows.columns))


def chain(stages: Sequence[Transformer], rows: DataFrame) -> DataFrame:
    for s in stages:
        rows = s.transform(rows)
    return rows


def drop_helpers(rows: DataFrame) -> DataFrame:
    return rows.drop(*[c for c in rows.columns if c.startswith("_")], FEATURES)


def scalers(train: DataFrame, task: Task) -> PipelineModel:
    return Pipeline(stages=scaling_stages(train, task.features, task.scaler, FEATURES)).fit(train)


def cached_parts(rows: DataFrame, task: Task) -> tuple[DataFrame, DataFrame]:
    """The training and the test part; the cache says which part a row belongs to, so that passes do not digest its key again."""
    held = in_share(quoted(task.key), task.test_share, task.seed)
    cached = rows.withColumn("_held", held).persist()
    return cached.where("NOT _held").drop("_held"), cached.where("_held").drop("_held")


def train_classifier(df: DataFrame, task: Task, fit: Fit, balance: bool = False) -> Fitted:
    """Fit on the training part of ``df`` and report precision, recall and F1 on the rest.

    The prepared rows are cached, so that the source is read once however many
    passes the learner makes.
    """
    train, test = cached_parts(prepare(df, task, True), task)
    model = fit_classifier(train, task, fit, balance)
    predictions = drop_helpers(model.transform(test))
    return Fitted(model, classification_report(predictions, task.target, PREDICTED), predictions)


def fit_classifier(train: DataFrame, task: Task, fit: Fit, balance: bool = False) -> PipelineModel:
    if balance:
        train = checkpointed(smote(train, task.key, task.features, task.target, seed=task.seed).withColumn(
            task.key, F.md5(F.concat_ws("/", *[quoted(f) for f in task.features], "synthetic"))))
    indexer = StringIndexer(inputCol=task.target, outputCol=LABEL, stringOrderType="alphabetAsc",
                            handleInvalid="skip").fit(train)
    scale = scalers(train, task)
    data = chain([indexer, scale], train).drop(task.target)
    task = Task(**{**task.__dict__, "classes": len(indexer.labels)})
    stages = fit(data, task)
    back = IndexToString(inputCol="_prediction", outputCol=PREDICTED, labels=indexer.labels)
    return PipelineModel([scale, *stages, back])


def train_regressor(df: DataFrame, task: Task, fit: Fit) -> Fitted:
    """Fit on the training part of ``df`` and report R2, MAE and MSE on the rest."""
    train, test = cached_parts(prepare(df, task, False), task)
    model = fit_regressor(train, task, fit)
    predictions = drop_helpers(model.transform(test))
    return Fitted(model, r2_mae(predictions, task.target, PREDICTED), predictions)


def fit_regressor(train: DataFrame, task: Task, fit: Fit) -> PipelineModel:
    scale = scalers(train, task)
    stages = fit(scale.transform(train).withColumnRenamed(task.target, LABEL), task)
    return PipelineModel([scale, *stages, projection(f"_prediction AS {PREDICTED}")])


def scaled_names(task: Task) -> list[str]:
    """Columns with the scaled features, next to the assembled vector."""
    if task.scaler == "normalizer":
        raise ValueError("the normalizer scales the vector only: choose another scaler for this model")
    return list(task.features) if task.scaler == "none" else [f"_{FEATURES}_{i}" for i in range(len(task.features))]


def sql_number(value: float) -> str:
    return f"CAST('{float(value)!r}' AS DOUBLE)"


def projection(expression: str) -> SQLTransformer:
    """A stage that adds one column; it is saved with the pipeline as text."""
    return SQLTransformer(statement=f"SELECT *, {expression} FROM __THIS__")


def balanced_weights(data: DataFrame, name: str = "_weight") -> DataFrame:
    """Weight every class equally: n / (classes * class size)."""
    sizes = {r[LABEL]: r["n"] for r in data.groupBy(LABEL).agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    weight = F.lit(1.0)
    for label, n in sizes.items():
        weight = F.when(F.col(LABEL) == label, total / (len(sizes) * n)).otherwise(weight)
    return data.withColumn(name, weight)


def row_count(data: DataFrame) -> int:
    return aggregate_once(data, {"n": F.count(F.lit(1))})["n"]


def folds(data: DataFrame, task: Task, k: int, level: int = 1) -> DataFrame:
    """Add ``_fold``; folds inside folds take another ``level``, so that the two are independent."""
    return data.withColumn("_fold", fold_of(task.key, k, task.seed + level))
