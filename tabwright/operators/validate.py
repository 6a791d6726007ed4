"""Checks a table must pass before it is modelled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tabwright.functions.columns import as_double, categorical_columns, is_numeric, melt, quoted
from tabwright.operators.profile import type_table
from tabwright.operators.stats import aggregate_once

RULES = "rule string, column string, severity string, value double"


def validate_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def validate_missing_by_column(df: DataFrame) -> DataFrame:
    """(column, missing, missing_pct) of the columns with missing values."""
    t = type_table(df).where(F.col("nulls") > 0)
    return t.select("column", F.col("nulls").alias("missing"),
                    F.round(F.col("nulls") / (F.col("nulls") + F.col("non_null")) * 100, 2).alias("missing_pct"))


def validate_categorical(df: DataFrame) -> DataFrame:
    """(column, dtype) of the non-numeric columns."""
    rows = [(c, df.schema[c].dataType.simpleString()) for c in categorical_columns(df)]
    return df.sparkSession.createDataFrame(rows, "column string, dtype string")


def value_shares(df: DataFrame) -> DataFrame:
    """(column, top_share): share of the most frequent value among the non-null ones."""
    counted = (melt(df, {c: quoted(c).cast("string") for c in df.columns}).where(F.col("value").isNotNull())
               .groupBy("column", "value").agg(F.count("*").alias("n")))
    return counted.groupBy("column").agg((F.max("n") / F.sum("n")).alias("top_share"))


def validate_near_constant(df: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Columns dominated by one value; columns without any value are left out."""
    return value_shares(df).where(F.col("top_share") > threshold)


def check_features_for_model(df: DataFrame, features: Sequence[str], target: str, max_classes: int = 10) -> DataFrame:
    """(rule, column, severity, value): what stands in the way of training a classifier."""
    spark = df.sparkSession
    absent = [("column_absent", c, "error", 1.0) for c in [*features, target] if c not in df.columns]
    if absent:
        return spark.createDataFrame(absent, RULES)
    types = {f.name: f.dataType for f in df.schema}
    rows = [("categorical_feature", c, "warning", 1.0) for c in features if not is_numeric(types[c])]
    exprs = {f"missing_{c}": F.count_if(quoted(c).isNull()) for c in features}
    exprs |= {f"bad_{c}": F.count_if(as_double(df, c).isNull() & quoted(c).isNotNull())
              for c in features if not is_numeric(types[c])}
    exprs["target_missing"] = F.count_if(quoted(target).isNull())
    exprs["classes"] = F.count_distinct(quoted(target))
    found = aggregate_once(df, exprs)
    rows += [("missing_in_feature", c, "warning", float(found[f"missing_{c}"])) for c in features
             if found[f"missing_{c}"]]
    rows += [("non_numeric_values", c, "warning", float(found[f"bad_{c}"])) for c in features if found.get(f"bad_{c}")]
    if found["target_missing"]:
        rows.append(("missing_in_target", target, "error", float(found["target_missing"])))
    if found["classes"] > max_classes:
        rows.append(("many_classes", target, "warning", float(found["classes"])))
    elif found["classes"] <= 1:
        rows.append(("single_class", target, "error", float(found["classes"])))
    return spark.createDataFrame(rows, RULES)


def is_trainable(report: DataFrame) -> bool:
    return report.where(F.col("severity") == "error").isEmpty()


def non_numeric_example(df: DataFrame, column: str, order_by: Sequence[str]) -> str | None:
    """First value of ``column`` that is no number."""
    bad = df.where(as_double(df, column).isNull() & quoted(column).isNotNull()).orderBy(*order_by)
    row = bad.select(quoted(column)).first()
    return None if row is None else row[0]


def cleaning_report(before: DataFrame, after: DataFrame, columns_dropped: int) -> DataFrame:
    """Shape before and after cleaning, and the nulls that are left."""
    nulls = sum((F.count_if(quoted(c).isNull()) for c in after.columns), F.lit(0).cast("bigint"))
    end = aggregate_once(after, {"n": F.count(F.lit(1)), "nulls": nulls})
    row = (before.count(), len(before.columns), end["n"], len(after.columns), columns_dropped, end["nulls"])
    return before.sparkSession.createDataFrame(
        [row], "original_rows long, original_columns int, final_rows long, final_columns int, columns_dropped int, "
               "remaining_nulls long")
