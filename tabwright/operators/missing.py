"""Where values are missing, and whether missingness depends on the data."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import sqrt

from pyspark.sql import DataFrame, functions as F

from tabwright.functions.columns import correlation, melt, null_flag, numeric_columns, quoted
from tabwright.functions.special import chi2_tail, t_two_sided
from tabwright.operators.stats import aggregate_once, average_ranks


def check_missing(df: DataFrame) -> DataFrame:
    """(column, total_missing, proportion, dtype)."""
    wide = df.agg(F.count("*").alias("_n"), *[F.count_if(quoted(c).isNull()).alias(f"m{i}")
                                              for i, c in enumerate(df.columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("total_missing"),
                              F.try_divide(F.col(f"m{i}"), F.col("_n")).alias("proportion"),
                              F.lit(df.schema[c].dataType.simpleString()).alias("dtype"))
                     for i, c in enumerate(df.columns)])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def missing_ranked(df: DataFrame) -> DataFrame:
    """(column, missing, percentage) from the most to the least incomplete column."""
    return check_missing(df).select("column", F.col("total_missing").alias("missing"), F.round(
        F.col("proportion") * 100, 2).alias("percentage")).orderBy(F.desc("missing"), "column")


def missing_shares(df: DataFrame) -> dict[str, float]:
    return aggregate_once(df, {c: F.avg(null_flag(c)) for c in df.columns})


def missing_matrix(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """0/1 null mask of every cell, next to the key columns."""
    return df.select(*[quoted(k) for k in keys], *[null_flag(c).alias(c) for c in df.columns if c not in keys])


def column_pairs(df: DataFrame, columns: Sequence[str], expr, name: str, batch: int = 400) -> DataFrame:
    """(column_a, column_b, name): an aggregate of every column pair, all pairs of a batch in one pass."""
    pairs = list(combinations(columns, 2))
    result = None
    for start in range(0, len(pairs), batch):
        part = pairs[start:start + batch]
        wide = df.agg(*[expr(a, b).alias(f"p{i}") for i, (a, b) in enumerate(part)])
        rows = F.array(*[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"p{i}").alias(name))
                         for i, (a, b) in enumerate(part)])
        long = wide.select(F.explode(rows).alias("r")).select("r.*")
        result = long if result is None else result.union(long)
    if result is None:
        raise ValueError("needs two columns or more")
    return result


def missing_correlation(df: DataFrame, columns: Sequence[str] | None = None, partly_only: bool = False) -> DataFrame:
    """(column_a, column_b, correlation) of the null indicators; NULL when an indicator is constant."""
    columns = list(columns or df.columns)
    if partly_only:
        shares = missing_shares(df.select(*[quoted(c) for c in columns]))
        columns = [c for c in columns if 0 < shares[c] < 1]
    return column_pairs(df, columns, lambda a, b: correlation(
        null_flag(a).cast("double"), null_flag(b).cast("double"), complete=True), "correlation")


def missing_cooccurrence(df: DataFrame, top: int = 15) -> DataFrame:
    """(column_a, column_b, both_missing) of the column pairs most often missing together."""
    shares = missing_shares(df)
    columns = [c for c in df.columns if 0 < shares[c] < 1]
    pairs = column_pairs(df, columns, lambda a, b: F.count_if(quoted(a).isNull() & quoted(b).isNull()), "both_missing")
    return pairs.orderBy(F.desc("both_missing"), "column_a", "column_b").limit(top)


def missing_patterns_top(df: DataFrame, top: int = 10) -> DataFrame:
    """Most frequent combinations of missing and present columns."""
    marks = df.select(*[F.when(quoted(c).isNull(), "Missing").otherwise("Present").alias(c) for c in df.columns])
    counted = marks.groupBy(*[quoted(c) for c in df.columns]).agg(F.count("*").alias("frequency"))
    return counted.orderBy(F.desc("frequency"), *[quoted(c) for c in df.columns]).limit(top)


def missing_monotone(df: DataFrame) -> DataFrame:
    """(monotone, violations): are the null sets of the columns nested?

    Columns are taken from the least to the most incomplete; a row violates the
    order when a column is missing but a more incomplete one is not.
    """
    shares = missing_shares(df)
    order = sorted((c for c in df.columns if shares[c]), key=lambda c: (shares[c], c))
    broken = F.lit(False)
    for a, b in zip(order, order[1:]):
        broken = broken | (quoted(a).isNull() & quoted(b).isNotNull())
    return df.agg(F.count_if(broken).alias("violations")).select(
        (F.col("violations") == 0).cast("int").alias("monotone"), "violations")


def missing_overall_share(df: DataFrame, simple_below: float = 0.05) -> DataFrame:
    """(missing_cells, cells, share, advice)."""
    missing = sum((F.count_if(quoted(c).isNull()) for c in df.columns), F.lit(0).cast("bigint"))
    t = df.agg(missing.alias("missing_cells"), (F.count("*") * len(df.columns)).alias("cells"))
    t = t.withColumn("share", F.try_divide("missing_cells", "cells"))
    return t.withColumn("advice", F.when(F.col("share") < simple_below, "simple imputation").otherwise(
        "model-based imputation"))


def mcar_test(df: DataFrame) -> dict:
    """Simplified test of missing completely at random, from the correlations of the null indicators.

    chi-square = (n - 1) * sum of squared pairwise correlations, with one degree
    of freedom per pair; not Little's original statistic.
    """
    numbers = numeric_columns(df)
    found = aggregate_once(df, {"_n": F.count(F.lit(1)), **{c: F.count_if(quoted(c).isNull()) for c in numbers}})
    columns = [c for c in numbers if found[c]]
    if len(columns) < 2:
        raise ValueError("needs two numeric columns with missing values")
    total = missing_correlation(df, columns).agg(F.sum(F.pow("correlation", 2)).alias("s")).first()["s"] or 0.0
    chi_square, dof = (found["_n"] - 1) * total, len(columns) * (len(columns) - 1) / 2
    return {"chi_square": chi_square, "dof": dof, "p_value": chi2_tail(chi_square, dof)}


def missing_mar_correlation(df: DataFrame, column: str, against: Sequence[str] | None = None) -> DataFrame:
    """(variable, rho, n, p_value, significant): Spearman of each numeric column with the null indicator of ``column``.

    An indicator has two values, so ranking it changes neither sign nor size of
    the correlation; only the other column needs ranks, one per distinct value.
    """
    others = list(against or numeric_columns(df, exclude=[column]))
    cells = melt(df, {c: quoted(c).cast("double") for c in others}, [column], name="variable").where(
        F.col("value").isNotNull()).groupBy("variable", "value").agg(
        F.count("*").alias("n"), F.sum(null_flag(column)).alias("missing"))
    ranks = average_ranks(cells, ["variable"])
    w, r, m = F.col("n"), F.col("rank"), F.col("missing")
    sums = ranks.groupBy("variable").agg(
        F.sum(w).alias("n"), F.sum(m).alias("sm"), (F.sum(r * m)).alias("srm"), F.max("_total").alias("t"),
        F.sum(w * F.pow(r - (F.col("_total") + 1) / 2, 2)).alias("srr"))
    cov = F.col("srm") - F.col("sm") * (F.col("n") + 1) / 2
    var_m = F.col("sm") - F.col("sm") * F.col("sm") / F.col("n")
    rho = F.try_divide(cov, F.sqrt(F.col("srr") * var_m))
    rows = []
    for s in sums.select("variable", rho.alias("rho"), "n").collect():  # one row per column
        p = None
        if s["rho"] is not None and s["n"] > 2:
            left = 1 - s["rho"] ** 2
            p = 0.0 if left <= 0 else t_two_sided(s["rho"] * sqrt((s["n"] - 2) / left), s["n"] - 2)
        rows.append((s["variable"], s["rho"], s["n"], p, None if p is None else p < 0.05))
    rows.sort(key=lambda x: (x[3] is None, x[3], x[0]))
    return df.sparkSession.createDataFrame(
        rows, "variable string, rho double, n long, p_value double, significant boolean")


def missing_group_ttest(df: DataFrame, value: str, indicator: str) -> DataFrame:
    """(t, dof, n_present, n_missing, p_value): Welch test of ``value`` where ``indicator`` is present or missing."""
    gone, x = quoted(indicator).isNull(), quoted(value).cast("double")
    parts = {}
    for name, where in (("p", ~gone), ("m", gone)):
        v = F.when(where, x)
        parts |= {f"n{name}": F.count(v), f"a{name}": F.avg(v), f"v{name}": F.var_samp(v)}
    s = aggregate_once(df, parts)
    if min(s["np"], s["nm"]) < 2:
        raise ValueError("each group needs two values")
    ep, em = s["vp"] / s["np"], s["vm"] / s["nm"]
    t = (s["ap"] - s["am"]) / sqrt(ep + em)
    dof = (ep + em) ** 2 / (ep ** 2 / (s["np"] - 1) + em ** 2 / (s["nm"] - 1))
    return df.sparkSession.createDataFrame(
        [(t, dof, s["np"], s["nm"], t_two_sided(t, dof))],
        "t double, dof double, n_present long, n_missing long, p_value double")


def missing_group_box(df: DataFrame, value: str, indicator: str) -> DataFrame:
    """Box statistics of ``value`` for rows where ``indicator`` is missing and where it is present."""
    from tabwright.operators.analyze import box_stats
    marked = df.select(F.when(quoted(indicator).isNull(), "Missing").otherwise("Present").alias("status"),
                       quoted(value))
    return box_stats(marked, value, ["status"])
