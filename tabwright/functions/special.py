"""Tail probabilities for test statistics, and the normal quantile as a column.

The scalar functions turn one statistic, already aggregated by Spark, into a
p-value; they are never applied to rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def chi2_tail(x: float, dof: float) -> float:
    """P(X > x) for a chi-square variable: regularised upper incomplete gamma."""
    if dof <= 0:
        return 1.0
    a, z = dof / 2.0, x / 2.0
    if z <= 0:
        return 1.0
    front = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1.0 - front * total)
    b = z + 1 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b)
        c = b + an / c
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return front * h


def beta_regularised(x: float, a: float, b: float) -> float:
    """I_x(a, b) by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_regularised(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(10_000):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + num * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + num / (c if abs(c) > tiny else tiny)
        f *= c * d
        if abs(1.0 - c * d) < 1e-15:
            break
    return front * (f - 1.0)


def t_two_sided(t: float, dof: float) -> float:
    """Two-sided p-value of Student's t."""
    if math.isinf(t):
        return 0.0
    return beta_regularised(dof / (dof + t * t), dof / 2.0, 0.5)


# Rational approximation of the normal quantile, algorithm AS 241
# (Wichura 1988); numerator and denominator from the highest power down.
CENTRE_NUM = [2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457,
              13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608]
CENTRE_DEN = [5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867,
              5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0]
NEAR_NUM = [7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258,
            3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734]
NEAR_DEN = [1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459,
            0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0]
FAR_NUM = [2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093,
           0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772]
FAR_DEN = [2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4,
           0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0]


def _horner(coefficients: list[float], x: Column) -> Column:
    result = F.lit(coefficients[0])
    for c in coefficients[1:]:
        result = result * x + F.lit(c)
    return result


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function, for 0 < p < 1."""
    q = p - 0.5
    centre = F.lit(0.180625) - q * q
    tail = F.sqrt(-F.log(F.least(p, 1 - p)))
    near, far = tail - 1.6, tail - 5.0
    outer = F.when(tail <= 5, _horner(NEAR_NUM, near) / _horner(NEAR_DEN, near)).otherwise(
        _horner(FAR_NUM, far) / _horner(FAR_DEN, far))
    return F.when(F.abs(q) <= 0.425, q * _horner(CENTRE_NUM, centre) / _horner(CENTRE_DEN, centre)).otherwise(
        F.signum(q) * outer)
