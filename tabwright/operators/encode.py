"""Encodings of categorical columns. Category tables are joined, never collected row by row."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import DataFrame, functions as F

from tabwright.functions.columns import quoted
from tabwright.operators.stats import Lookup, dense_codes

MAX_ONE_HOT_COLUMNS = 1_000


def _has_enough(df: DataFrame, column: str, min_distinct: int) -> bool:
    """At least ``min_distinct`` different values, a missing value counting as one."""
    return len(df.select(quoted(column)).distinct().take(min_distinct)) >= min_distinct


def label_codes(df: DataFrame, column: str) -> Lookup:
    """(column, code): the sorted distinct values numbered from 0."""
    return dense_codes(df.select(quoted(column)).where(quoted(column).isNotNull()).distinct(), [column])


def encode_label(df: DataFrame, column: str, codes: Lookup | None = None) -> DataFrame:
    """Replace a column by the number of its value; NULL stays NULL."""
    codes = codes or label_codes(df, column)
    own = f"_{column}_{uuid.uuid4().hex}"  # keeps a column of the table that has the name of the code
    plain = df.withColumnRenamed("code", own) if column != "code" else df
    joined = codes.attach(plain, [column])
    return joined.select(*[F.col("code").alias(c) if c == column else quoted(own if c == "code" else c).alias(c)
                           for c in df.columns])


def encode_label_inverse(df: DataFrame, column: str, codes: Lookup) -> DataFrame:
    """Numbers back to the values they stand for."""
    back = codes.table.select(F.col("code").alias(column), quoted(column).alias("_value"))
    joined = df.join(F.broadcast(back) if codes.small else back, column, "left")
    return joined.withColumn(column, F.col("_value")).select(*[quoted(c) for c in df.columns])


def encode_one_hot(df: DataFrame, column: str, min_distinct: int = 3,
                   max_columns: int = MAX_ONE_HOT_COLUMNS) -> DataFrame:
    """0/1 columns ``{column}_{value}`` in value order replace the column; NULL has its own ``{column}_nan``.

    Columns with two values or fewer are left alone. Each value becomes a column
    of the schema; use ``encode_one_hot_vector`` for more than ``max_columns``.
    """
    values = [r[0] for r in df.select(quoted(column)).distinct().limit(max_columns + 1).collect()]
    if len(values) < min_distinct:
        return df
    if len(values) > max_columns:
        raise ValueError(f"{column} has over {max_columns} values: use encode_one_hot_vector")
    known = sorted(v for v in values if v is not None)
    result = df.withColumns({f"{column}_{v}": F.coalesce((quoted(column) == F.lit(v)).cast("double"), F.lit(0.0))
                             for v in known})
    if len(known) < len(values):
        result = result.withColumn(f"{column}_nan", quoted(column).isNull().cast("double"))
    return result.drop(column)


def encode_one_hot_vector(df: DataFrame, column: str) -> DataFrame:
    """The same as one sparse vector column ``{column}_onehot``, for any number of values."""
    index = f"_{column}_index"
    stages = [StringIndexer(inputCol=column, outputCol=index, stringOrderType="alphabetAsc", handleInvalid="keep"),
              OneHotEncoder(inputCol=index, outputCol=f"{column}_onehot", dropLast=False)]
    return Pipeline(stages=stages).fit(df).transform(df).drop(index, column)


def category_means(df: DataFrame, column: str, target: str) -> Lookup:
    return Lookup(df.where(quoted(column).isNotNull()).groupBy(quoted(column)).agg(
        F.avg(quoted(target)).alias("_mean")))


def encode_mean(df: DataFrame, column: str, target: str, min_distinct: int = 3) -> DataFrame:
    """Add ``{column}_mean_encoded``, the mean target of the category."""
    if not _has_enough(df, column, min_distinct):
        return df
    return category_means(df, column, target).attach(df, [column]).select(
        *[quoted(c) for c in df.columns], F.col("_mean").alias(f"{column}_mean_encoded"))


def encode_target(df: DataFrame, column: str, target: str, min_distinct: int = 3) -> DataFrame:
    """Replace the column by the mean target of the category."""
    if not _has_enough(df, column, min_distinct):
        return df
    joined = category_means(df, column, target).attach(df, [column])
    return joined.select(*[F.col("_mean").alias(c) if c == column else quoted(c) for c in df.columns])


def encode_frequency(df: DataFrame, column: str) -> DataFrame:
    """Add ``{column}_freq_encoded``, the number of rows of the category."""
    counts = Lookup(df.where(quoted(column).isNotNull()).groupBy(quoted(column)).agg(F.count("*").alias("_n")))
    return counts.attach(df, [column]).select(*[quoted(c) for c in df.columns],
                                              F.col("_n").alias(f"{column}_freq_encoded"))


def encode_binary(df: DataFrame, column: str, order_by: Sequence[str]) -> DataFrame:
    """Add the bits of a code given by first appearance, ``{column}_bin_0`` being the most significant."""
    first = df.where(quoted(column).isNotNull()).groupBy(quoted(column)).agg(
        F.min(F.struct(*[quoted(c) for c in order_by])).alias("_seen"))
    codes = dense_codes(first, ["_seen"], "_code")
    width = max(1, int(codes.table.count()).bit_length())
    joined = codes.attach(df, [column])
    bits = {f"{column}_bin_{i}": F.shiftright("_code", width - 1 - i).bitwiseAND(F.lit(1)).cast("int")
            for i in range(width)}
    return joined.withColumns(bits).select(*[quoted(c) for c in df.columns], *[quoted(b) for b in bits])
