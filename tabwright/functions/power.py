"""Power transforms of one column; the exponent may differ from row to row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def box_cox(x: Column, lam: Column) -> Column:
    """Defined for x > 0; NULL elsewhere."""
    positive = F.when(x > 0, x)
    return F.when(lam == 0, F.log(positive)).otherwise((F.pow(positive, lam) - 1) / F.nullif(lam, F.lit(0.0)))


def yeo_johnson(x: Column, lam: Column) -> Column:
    mirrored = 2 - lam
    up = F.when(lam == 0, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / F.nullif(lam, F.lit(0.0)))
    down = F.when(mirrored == 0, -F.log1p(-x)).otherwise(
        -(F.pow(1 - x, mirrored) - 1) / F.nullif(mirrored, F.lit(0.0)))
    return F.when(x >= 0, up).when(x < 0, down)


def box_cox_jacobian(x: Column) -> Column:
    return F.log(F.when(x > 0, x))


def yeo_johnson_jacobian(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))
