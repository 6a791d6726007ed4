"""Projections, row filters and type conversion."""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabwright.functions.columns import (all_of, any_of, as_double, as_one, is_numeric, numeric_columns, quoted,
                                         require_columns)
from tabwright.operators.stats import aggregate_once, row_positions

COMPARISONS = {"==": operator.eq, "!=": operator.ne, ">": operator.gt, "<": operator.lt, ">=": operator.ge,
               "<=": operator.le}


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    require_columns(df, columns)
    return df.select(*[quoted(c) for c in columns])


def drop_columns(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The table without ``columns``, and the names it does not have."""
    unknown = [c for c in columns if c not in df.columns]
    return df.drop(*columns), unknown


def search_rows(df: DataFrame, term: str) -> DataFrame:
    """Rows in which the text of any column matches the regular expression, ignoring case."""
    return df.where(as_one(any_of([F.coalesce(quoted(c).cast("string").rlike(f"(?i){term}"), F.lit(False))
                                   for c in df.columns])))


def condition(df: DataFrame, column: str, comparison: str, value) -> Column:
    """``column comparison value`` as a Column; ``value`` is data, never code."""
    require_columns(df, [column])
    if comparison not in COMPARISONS:
        raise ValueError(f"unknown comparison {comparison}")
    if isinstance(df.schema[column].dataType, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return COMPARISONS[comparison](quoted(column), F.lit(value).cast(df.schema[column].dataType))
    return COMPARISONS[comparison](quoted(column), F.lit(value))


def filter_compare(df: DataFrame, filters: Sequence[tuple[str, str, object]]) -> DataFrame:
    """Rows meeting every (column, comparison, value); != keeps missing values, as in a table tool."""
    parts = []
    for column, comparison, value in filters:
        c = condition(df, column, comparison, value)
        parts.append(F.coalesce(c, F.lit(True)) if comparison == "!=" else c)
    return df.where(all_of(parts))


def flag_rows(df: DataFrame, column: str, comparison: str, value, name: str = "highlight") -> DataFrame:
    return df.withColumn(name, F.coalesce(condition(df, column, comparison, value), F.lit(False)).cast("int"))


def preview_head(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def to_float_all(df: DataFrame) -> DataFrame:
    """Numbers become double; text becomes double where it can, else NULL."""
    return df.withColumns({f.name: as_double(df, f.name) for f in df.schema
                           if is_numeric(f.dataType) or isinstance(f.dataType, T.StringType)})


def to_float_guarded(df: DataFrame, max_loss: float = 0.5) -> DataFrame:
    """Numeric columns as double; text columns join them unless conversion loses more than ``max_loss`` of the rows."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    keep = set(numeric_columns(df))
    if texts:
        lost = aggregate_once(df, {c: F.avg(as_double(df, c).isNull().cast("int")) for c in texts})
        keep |= {c for c in texts if lost[c] is not None and lost[c] <= max_loss}
    return df.select(*[as_double(df, c).alias(c) for c in df.columns if c in keep])


def coerce_numeric(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, as_double(df, column))


def sample_every_k(df: DataFrame, order_by: Sequence[str], target: int = 100) -> DataFrame:
    """Every ``max(1, n // target)``-th row in order; all rows when there are at most ``target``."""
    n = df.count()
    if n <= target:
        return df
    return row_positions(df, order_by).where(F.col("position") % max(1, n // target) == 0).drop("position")


def apply_user_function(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Table in, table out."""
    return df.transform(fn)


def apply_user_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    """Row batches through a pandas function; ``fn`` must not depend on how rows are batched."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return map(fn, batches)
    return df.mapInPandas(run, schema)
