"""Overview tables: shape, types, descriptive statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tabwright.functions.columns import categorical_columns, melt, numeric_columns, quoted
from tabwright.operators.stats import grouped_quantiles, join_on_keys

QUARTILES = (0.25, 0.5, 0.75)
STATISTICS = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")


def _per_column(df: DataFrame, exprs: dict[str, tuple[str, object]]) -> DataFrame:
    """One aggregate over all columns, reshaped to a row per column.

    ``exprs`` maps an output field to (type, function of a column name).
    """
    wide = df.agg(*[fn(c).cast(dtype).alias(f"{field}_{i}") for i, c in enumerate(df.columns)
                    for field, (dtype, fn) in exprs.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                              *[F.col(f"{field}_{i}").alias(field) for field in exprs])
                     for i, c in enumerate(df.columns)])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def dataset_info(df: DataFrame) -> DataFrame:
    """(column, dtype, non_null, rows, columns)."""
    return _per_column(df, {"non_null": ("bigint", lambda c: F.count(quoted(c))),
                            "rows": ("bigint", lambda c: F.count(F.lit(1)))}).withColumn(
        "columns", F.lit(len(df.columns)))


def type_table(df: DataFrame) -> DataFrame:
    """(column, dtype, non_null, nulls)."""
    return _per_column(df, {"non_null": ("bigint", lambda c: F.count(quoted(c))),
                            "nulls": ("bigint", lambda c: F.count_if(quoted(c).isNull()))})


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, column, count, mean, std, min, 25%, 50%, 75%, max); std is the sample deviation."""
    columns = list(columns or numeric_columns(df, exclude=by))
    by = list(by)
    as_num = {c: quoted(c).cast("double") for c in columns}
    wide = df.groupBy(*by).agg(*[e for i, c in enumerate(columns) for e in (
        F.count(as_num[c]).alias(f"count_{i}"), F.avg(as_num[c]).alias(f"mean_{i}"),
        F.stddev_samp(as_num[c]).alias(f"std_{i}"), F.min(as_num[c]).alias(f"min_{i}"),
        F.max(as_num[c]).alias(f"max_{i}"))])
    moments = melt(wide, {c: F.struct(*[F.col(f"{s}_{i}").alias(s) for s in ("count", "mean", "std", "min", "max")])
                          for i, c in enumerate(columns)}, by, value="m")
    quartiles = grouped_quantiles(df, columns, QUARTILES, by)
    joined = join_on_keys(moments, quartiles, [*by, "column"], "left")
    return joined.select(*[quoted(k) for k in by], "column", "m.count", "m.mean", "m.std", "m.min",
                         *[F.col("quantiles")[i].alias(n) for i, n in enumerate(("25%", "50%", "75%"))], "m.max")


def describe_all(df: DataFrame) -> DataFrame:
    """Numeric columns as in ``describe_numeric``; others get unique, top and freq."""
    numbers, texts = numeric_columns(df), categorical_columns(df)
    parts = []
    if numbers:
        parts.append(describe_numeric(df, numbers).withColumns({
            "unique": F.lit(None).cast("bigint"), "top": F.lit(None).cast("string"),
            "freq": F.lit(None).cast("bigint")}))
    if texts:
        counted = (melt(df, {c: quoted(c).cast("string") for c in texts}).where(F.col("value").isNotNull())
                   .groupBy("column", "value").agg(F.count("*").alias("n")))
        best = counted.groupBy("column").agg(
            F.sum("n").alias("count"), F.count("*").alias("unique"),
            F.min(F.struct((-F.col("n")).alias("k"), "value")).alias("b"))
        parts.append(best.select(
            "column", "count", *[F.lit(None).cast("double").alias(s) for s in STATISTICS[1:]],
            "unique", F.col("b.value").alias("top"), (-F.col("b.k")).alias("freq")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def overview_metrics(df: DataFrame) -> DataFrame:
    """(rows, columns, missing_cells, text_bytes); text_bytes estimates the size by the length of the values as text."""
    missing = sum((F.count_if(quoted(c).isNull()) for c in df.columns), F.lit(0).cast("bigint"))
    size = sum((F.coalesce(F.sum(F.octet_length(quoted(c).cast("string"))), F.lit(0)) for c in df.columns),
               F.lit(0).cast("bigint"))
    return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"), missing.alias("missing_cells"),
                  size.alias("text_bytes"))


def column_profile(df: DataFrame, order_by: Sequence[str], samples: int = 3, approximate: bool = False) -> DataFrame:
    """(column, dtype, missing, missing_pct, distinct, samples): the first non-null values in row order as text."""
    counter = F.approx_count_distinct if approximate else F.count_distinct
    counts = _per_column(df, {"missing": ("bigint", lambda c: F.count_if(quoted(c).isNull())),
                              "missing_pct": ("double", lambda c: F.round(
                                  F.avg(quoted(c).isNull().cast("int")) * 100, 1)),
                              "distinct": ("bigint", lambda c: counter(quoted(c)))})
    keyed = df.withColumn("_order", F.struct(*[quoted(c) for c in order_by]))
    cells = melt(keyed, {c: quoted(c).cast("string") for c in df.columns}, ["_order"]).where(
        F.col("value").isNotNull())
    # a row_number limit is applied inside each partition before the shuffle
    first = cells.withColumn("_rn", F.row_number().over(Window.partitionBy("column").orderBy("_order"))).where(
        F.col("_rn") <= samples)
    shown = first.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("_rn", "value"))).alias("s")).select(
        "column", F.array_join(F.col("s.value"), ", ").alias("samples"))
    return counts.join(shown, "column", "left")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(quoted(column)).distinct()
