"""Scalers and power transforms of numeric columns: one aggregate to fit, one projection to apply."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import Normalizer, SQLTransformer, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from tabwright.functions.columns import as_double, quoted
from tabwright.functions.power import box_cox, box_cox_jacobian, yeo_johnson, yeo_johnson_jacobian
from tabwright.functions.special import normal_quantile
from tabwright.operators.stats import aggregate_once, quantiles

SUFFIX = {"standard": "_scaled", "minmax": "_minmax_scaled", "robust": "_robust_scaled"}


@dataclass(frozen=True)
class Linear:
    """(x - centre) / scale, written to ``output``; also applies to streams."""

    column: str
    output: str
    centre: float
    scale: float

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.output, (quoted(self.column).cast("double") - self.centre) / self.scale)

    def sql(self) -> str:
        name = self.column.replace("`", "``")
        return f"(CAST(`{name}` AS DOUBLE) - CAST('{self.centre!r}' AS DOUBLE)) / CAST('{self.scale!r}' AS DOUBLE)"


def fit_linear(df: DataFrame, columns: Sequence[str], kind: str) -> list[Linear]:
    """``standard`` uses the population deviation; a zero spread divides by 1."""
    if kind == "robust":
        found = {c: (q[1], q[2] - q[0]) for c, q in quantiles(df, columns, [0.25, 0.5, 0.75]).items()}
    elif kind in ("standard", "minmax"):
        low, wide = (F.avg, F.stddev_pop) if kind == "standard" else (F.min, F.max)
        s = aggregate_once(df, {f"{k}{i}": fn(quoted(c).cast("double")) for i, c in enumerate(columns)
                                for k, fn in (("a", low), ("b", wide))})
        found = {c: (s[f"a{i}"], s[f"b{i}"] if kind == "standard" else s[f"b{i}"] - s[f"a{i}"])
                 for i, c in enumerate(columns)}
    else:
        raise ValueError(f"unknown scaler {kind}")
    return [Linear(c, c + SUFFIX[kind], a, b or 1.0) for c, (a, b) in found.items()]


def _scaled(df: DataFrame, column: str, kind: str) -> DataFrame:
    return fit_linear(df, [column], kind)[0].transform(df)


def scale_standard(df: DataFrame, column: str) -> DataFrame:
    return _scaled(df, column, "standard")


def scale_minmax(df: DataFrame, column: str) -> DataFrame:
    return _scaled(df, column, "minmax")


def scale_robust(df: DataFrame, column: str) -> DataFrame:
    return _scaled(df, column, "robust")


def normalize_l2(df: DataFrame, column: str) -> DataFrame:
    """Row-wise unit length of a single column: the sign of the value."""
    return df.withColumn(f"{column}_normalized", F.signum(quoted(column).cast("double")))


def log1p(df: DataFrame, column: str) -> DataFrame:
    """ln(1 + x); NULL where x <= -1."""
    return df.withColumn(f"{column}_log_transformed", F.log1p(quoted(column).cast("double")))


def polynomial(df: DataFrame, column: str, degree: int = 2) -> DataFrame:
    """Add ``{column}_poly_0`` to ``{column}_poly_{degree}``, the powers of x."""
    x = quoted(column).cast("double")
    return df.withColumns({f"{column}_poly_{i}": F.pow(x, F.lit(i)) for i in range(degree + 1)})


POWERS: dict[str, tuple[Callable, Callable, str]] = {
    "box-cox": (box_cox, box_cox_jacobian, "_boxcox_transformed"),
    "yeo-johnson": (yeo_johnson, yeo_johnson_jacobian, "_yeojohnson_transformed"),
}


@dataclass(frozen=True)
class Power:
    """A power transform with its exponent, standardised afterwards."""

    column: str
    method: str
    lam: float
    mean: float
    std: float

    def transform(self, df: DataFrame) -> DataFrame:
        fn, _, suffix = POWERS[self.method]
        y = fn(quoted(self.column).cast("double"), F.lit(self.lam))
        return df.withColumn(self.column + suffix, (y - self.mean) / self.std)


def power_with_exponent(df: DataFrame, column: str, method: str, lam: float) -> Power:
    fn = POWERS[method][0]
    y = fn(quoted(column).cast("double"), F.lit(float(lam)))
    s = aggregate_once(df, {"m": F.avg(y), "d": F.stddev_pop(y)})
    return Power(column, method, lam, s["m"], s["d"] or 1.0)


def fit_power(df: DataFrame, column: str, method: str, low: float = -5.0, high: float = 5.0,
              points: int = 41, rounds: int = 3, widest: float = 100.0) -> Power:
    """Exponent of maximum likelihood; each pass evaluates a whole grid of exponents.

    One aggregate holds the variance at every exponent. While the best point is at an end of the grid, the grid is moved
    on past that end. Each round narrows it to the neighbours of the best point; a parabola through the last three gives
    the exponent to about eight digits.
    """
    fn, jacobian, _ = POWERS[method]
    x = quoted(column).cast("double")
    if method == "box-cox" and not df.where(x <= 0).isEmpty():
        raise ValueError(f"{column} has values that are not positive")
    values = df.where(x.isNotNull()).select(x.alias("x"))
    s = aggregate_once(values, {"n": F.count("x"), "j": F.sum(jacobian(F.col("x")))})
    def scores(grid: np.ndarray) -> np.ndarray:
        spread = aggregate_once(values, {str(i): F.var_pop(fn(F.col("x"), F.lit(float(g)))) for i, g in enumerate(grid)})
        score = np.array([-np.inf if not (v := spread[str(i)]) else -s["n"] / 2 * np.log(v) + (g - 1) * s["j"]
                          for i, g in enumerate(grid)])
        return np.where(np.isfinite(score), score, -np.inf)
    grid = np.linspace(low, high, points)
    score = scores(grid)
    for _ in range(rounds - 1):
        while (best := int(score.argmax())) in (0, points - 1) and np.isfinite(score[best]) and abs(grid[best]) < widest:
            further = grid - grid[-1] + grid[1] if best == 0 else grid - grid[0] + grid[-2]
            moved = scores(further)
            if moved.max() <= score.max():
                break
            grid, score = further, moved
        best = int(np.clip(score.argmax(), 1, points - 2))
        grid = np.linspace(grid[best - 1], grid[best + 1], points)
        score = scores(grid)
    best = int(np.clip(score.argmax(), 1, points - 2))
    a, b, c = score[best - 1:best + 2]
    bend = a - 2 * b + c
    step = grid[1] - grid[0]
    lam = float(grid[best] + (0.5 * step * (a - c) / bend if np.isfinite(bend) and bend < 0 else 0.0))
    return power_with_exponent(df, column, method, lam)


def box_cox_transform(df: DataFrame, column: str) -> DataFrame:
    return fit_power(df, column, "box-cox").transform(df)


def yeo_johnson_transform(df: DataFrame, column: str) -> DataFrame:
    return fit_power(df, column, "yeo-johnson").transform(df)


@dataclass(frozen=True)
class QuantileMap:
    """Empirical distribution function from reference quantiles."""

    column: str
    references: tuple[float, ...]
    output: str = "uniform"

    def transform(self, df: DataFrame) -> DataFrame:
        q = np.array(self.references)
        r = np.linspace(0, 1, len(q))

        @F.pandas_udf("double")
        def share(x: pd.Series) -> pd.Series:
            v = x.to_numpy(dtype=float)
            # ties sit on a step of the function: average its lower and its upper end
            f = 0.5 * (np.interp(v, q, r) - np.interp(-v, -q[::-1], -r[::-1]))
            f = np.where(v <= q[0], 0.0, np.where(v >= q[-1], 1.0, f))
            return pd.Series(np.where(np.isnan(v), np.nan, f))

        value = share(quoted(self.column).cast("double"))
        name = f"{self.column}_quantile_transformed"
        result = df.withColumn(name, value).withColumn(name, F.when(quoted(self.column).isNotNull(), quoted(name)))
        if self.output == "uniform":
            return result
        inside = F.least(F.greatest(quoted(name), F.lit(1e-7)), F.lit(1 - 1e-7))
        return result.withColumn(name, F.when(quoted(name).isNotNull(), normal_quantile(inside)))


def fit_quantile(df: DataFrame, column: str, output: str = "uniform", references: int = 1000) -> QuantileMap:
    if output not in ("uniform", "normal"):
        raise ValueError(f"unknown output {output}")
    n = aggregate_once(df, {"n": F.count(quoted(column))})["n"]
    points = np.linspace(0, 1, max(1, min(references, n)))
    return QuantileMap(column, tuple(quantiles(df, [column], [float(p) for p in points])[column]), output)


def quantile_transform(df: DataFrame, column: str, output: str = "uniform") -> DataFrame:
    return fit_quantile(df, column, output).transform(df)


def scaling_stages(df: DataFrame, features: Sequence[str], scaler: str = "standard", output: str = "features") -> list:
    """Pipeline stages from raw columns to one scaled vector: standard, minmax, robust, normalizer or none.

    The fitted numbers live in a SQL projection, so a saved pipeline needs none of this package to score.
    """
    if scaler in ("none", "normalizer"):
        raw = output if scaler == "none" else f"_{output}_raw"
        stages = [VectorAssembler(inputCols=list(features), outputCol=raw, handleInvalid="keep")]
        return stages if scaler == "none" else [*stages, Normalizer(inputCol=raw, outputCol=output, p=2.0)]
    fitted = fit_linear(df, features, scaler)
    names = [f"_{output}_{i}" for i in range(len(fitted))]
    statement = "SELECT *, " + ", ".join(f"{t.sql()} AS {n}" for t, n in zip(fitted, names)) + " FROM __THIS__"
    return [SQLTransformer(statement=statement),
            VectorAssembler(inputCols=names, outputCol=output, handleInvalid="keep")]


def assemble_scale(df: DataFrame, features: Sequence[str], scaler: str = "standard") -> DataFrame:
    """Features scaled in place of the originals, as columns."""
    if scaler == "normalizer":
        norm = F.sqrt(sum((F.pow(as_double(df, c), F.lit(2)) for c in features), F.lit(0.0)))
        return df.withColumn("_norm", norm).withColumns({
            c: F.when(F.col("_norm") == 0, 0.0).otherwise(as_double(df, c) / F.col("_norm")) for c in features}).drop(
            "_norm")
    fitted = fit_linear(df, features, scaler)
    return df.withColumns({t.column: (quoted(t.column).cast("double") - t.centre) / t.scale for t in fitted})
