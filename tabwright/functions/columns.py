"""Column-level helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T


def quoted(name: str) -> Column:
    """Column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if is_numeric(f.dataType) and f.name not in skip]


def categorical_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Complement of the numeric columns."""
    skip = set(exclude)
    return [f.name for f in df.schema if not is_numeric(f.dataType) and f.name not in skip]


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"columns not found: {', '.join(unknown)}")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Make NULL the only missing value; NaN in float columns becomes NULL."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not floats:
        return df
    return df.withColumns({c: F.when(~F.isnan(quoted(c)), quoted(c)) for c in floats})


def as_double(df: DataFrame, name: str) -> Column:
    """Numeric value of a column; text that is no number becomes NULL."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.StringType, T.NumericType, T.BooleanType)):
        value = quoted(name).try_cast("double") if isinstance(dtype, T.StringType) else quoted(name).cast("double")
        return F.when(~F.isnan(value), value)
    raise ValueError(f"column {name} of type {dtype.simpleString()} has no numeric form")


def null_flag(name: str) -> Column:
    return quoted(name).isNull().cast("int")


def round_doubles(df: DataFrame, places: int = 6, **special: int) -> DataFrame:
    """Round every double column, for comparison between engines."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.round(quoted(c).cast("double"), special.get(c, places)) for c in doubles})


def melt(df: DataFrame, values: Mapping[str, Column], keys: Iterable[str] = (), name: str = "column",
         value: str = "value") -> DataFrame:
    """Long form: one row per entry of ``values``; all values must share a type."""
    pairs = F.array(*[F.struct(F.lit(label).alias(name), expr.alias(value)) for label, expr in values.items()])
    return df.select(*[quoted(k) for k in keys], F.explode(pairs).alias("_pair")).select(
        *[quoted(k) for k in keys], F.col(f"_pair.{name}"), F.col(f"_pair.{value}"))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def correlation(x: Column, y: Column, complete: bool = False) -> Column:
    """Pearson aggregate over the rows with both values; NULL, not an error, when either is constant.

    ``complete`` states that neither side has missing values.
    """
    vx, vy = (x, y) if complete else (F.when(y.isNotNull(), x), F.when(x.isNotNull(), y))
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(vx) * F.var_pop(vy)))


def none_missing(names: Iterable[str]) -> Column:
    """All columns have values, as separate conditions.

    One predicate over many computed columns (such as ``dropna`` makes) lets the
    optimizer infer a constraint for every mix of column and expression, 2^n of
    them; a conjunction keeps that linear.
    """
    return all_of([quoted(n).isNotNull() for n in names])


def as_one(condition: Column) -> Column:
    """A condition over many columns that the optimizer neither moves nor derives constraints from."""
    return F.when(F.rand() >= 0, condition)
