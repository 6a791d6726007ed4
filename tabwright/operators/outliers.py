"""Outlier rules on one column: a fitted rule is a few numbers, applied as a projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tabwright.functions.columns import quoted
from tabwright.operators.stats import aggregate_once, quantiles

# Fixed values of the rules.
IQR_FACTOR = 1.5
SIGMAS = 3.0
MAD_SCALE = 0.6745
MAD_CUT = 3.5
WARN_SHARE = 0.05


@dataclass(frozen=True)
class Fences:
    """Values below ``low`` or above ``high`` are outliers; NULL never is."""

    column: str
    low: float | None
    high: float | None

    def is_outlier(self) -> Column:
        if self.low is None or self.high is None:
            return F.lit(False)
        x = quoted(self.column)
        return F.coalesce((x < self.low) | (x > self.high), F.lit(False))

    def flag(self, df: DataFrame, name: str = "is_outlier") -> DataFrame:
        return df.withColumn(name, self.is_outlier().cast("int"))

    def drop(self, df: DataFrame) -> DataFrame:
        return df.where(~self.is_outlier())

    def clamp(self, df: DataFrame, strategy: str = "both") -> DataFrame:
        """Pull outliers to the fences: ``both``, ``top`` or ``bottom``."""
        if strategy not in ("both", "top", "bottom"):
            raise ValueError(f"unknown strategy {strategy}")
        if self.low is None or self.high is None:
            return df
        x = quoted(self.column).cast("double")
        value = x
        if strategy != "bottom":
            value = F.when(x > self.high, self.high).otherwise(value)
        if strategy != "top":
            value = F.when(x < self.low, self.low).otherwise(value)
        return df.withColumn(self.column, value)


def fit_iqr(df: DataFrame, column: str, k: float = IQR_FACTOR) -> Fences:
    q = quantiles(df, [column], [0.25, 0.75])[column]
    if not q or q[0] is None:
        return Fences(column, None, None)
    return Fences(column, q[0] - k * (q[1] - q[0]), q[1] + k * (q[1] - q[0]))


def fit_mean_std(df: DataFrame, column: str, sigmas: float = SIGMAS) -> Fences:
    s = aggregate_once(df, {"m": F.avg(quoted(column)), "d": F.stddev_samp(quoted(column))})
    if s["m"] is None or s["d"] is None:
        return Fences(column, None, None)
    return Fences(column, s["m"] - sigmas * s["d"], s["m"] + sigmas * s["d"])


@dataclass(frozen=True)
class MadRule:
    """Modified z-score from the median and the median absolute deviation."""

    column: str
    median: float | None
    mad: float | None
    cut: float = MAD_CUT

    def score(self) -> Column:
        """NULL where the deviation is 0: no value can then be judged."""
        if not self.mad:
            return F.lit(None).cast("double")
        return F.lit(MAD_SCALE) * (quoted(self.column) - self.median) / self.mad

    def is_outlier(self) -> Column:
        return F.coalesce(F.abs(self.score()) > self.cut, F.lit(False))

    def flag(self, df: DataFrame, name: str = "is_outlier") -> DataFrame:
        return df.withColumn(name, self.is_outlier().cast("int"))


def fit_mad(df: DataFrame, column: str, cut: float = MAD_CUT) -> MadRule:
    centre = quantiles(df, [column], [0.5])[column]
    if not centre or centre[0] is None:
        return MadRule(column, None, None, cut)
    spread = quantiles(df.select(F.abs(quoted(column) - centre[0]).alias("d")), ["d"], [0.5])["d"]
    return MadRule(column, centre[0], spread[0], cut)


def outlier_iqr(df: DataFrame, column: str, k: float = IQR_FACTOR) -> DataFrame:
    return fit_iqr(df, column, k).flag(df)


def outlier_mean_std(df: DataFrame, column: str, sigmas: float = SIGMAS) -> DataFrame:
    return fit_mean_std(df, column, sigmas).flag(df)


def outlier_mad(df: DataFrame, column: str, cut: float = MAD_CUT) -> DataFrame:
    return fit_mad(df, column, cut).flag(df)


def winsorize(df: DataFrame, column: str, strategy: str = "both", k: float = IQR_FACTOR) -> DataFrame:
    return fit_iqr(df, column, k).clamp(df, strategy)


def drop_outliers(df: DataFrame, column: str, k: float = IQR_FACTOR) -> DataFrame:
    return fit_iqr(df, column, k).drop(df)


def outlier_summary(df: DataFrame, column: str, warn_share: float = WARN_SHARE) -> DataFrame:
    """(method, outliers, share, warn) of the three one-column rules."""
    rules = {"iqr": fit_iqr(df, column), "mean_std": fit_mean_std(df, column), "mad": fit_mad(df, column)}
    wide = df.agg(F.count("*").alias("n"), *[F.count_if(r.is_outlier()).alias(m) for m, r in rules.items()])
    rows = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("outliers"),
                              F.try_divide(F.col(m), F.col("n")).alias("share")) for m in rules])
    return wide.select(F.explode(rows).alias("r")).select(
        "r.*", (F.col("r.share") > warn_share).cast("int").alias("warn"))
