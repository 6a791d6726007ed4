"""Dropping and filling missing values, and removing duplicate rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tabwright.functions.columns import (as_one, categorical_columns, is_numeric, melt, none_missing, null_flag,
                                         numeric_columns, quoted, require_columns)
from tabwright.operators.missing import missing_shares
from tabwright.operators.profile import STATISTICS, describe_numeric
from tabwright.operators.stats import (Lookup, aggregate_once, grouped_modes, grouped_quantiles, join_on_keys, mode_field,
                                       modes, prefix_sums, quantiles, row_positions)
from tabwright.session import checkpointed


def drop_missing_rows(df: DataFrame, thresh: int = 0) -> DataFrame:
    """Rows without missing values, or with at least ``thresh`` values when it is not 0."""
    if not thresh:
        return df.where(none_missing(df.columns))
    present = sum((quoted(c).isNotNull().cast("int") for c in df.columns), F.lit(0))
    return df.where(as_one(present >= thresh))


def drop_missing_cols(df: DataFrame, thresh: int = 0) -> DataFrame:
    """The same by column."""
    found = aggregate_once(df, {"_n": F.count(F.lit(1)), **{c: F.count(quoted(c)) for c in df.columns}})
    need = thresh or found["_n"]
    return df.drop(*[c for c in df.columns if found[c] < need])


def drop_sparse_columns(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    shares = missing_shares(df)
    return df.drop(*[c for c in df.columns if shares[c] is not None and shares[c] > threshold])


def missing_indicator(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Add ``{col}_is_missing`` for the columns that have missing values."""
    shares = missing_shares(df.select(*[quoted(c) for c in columns or df.columns]))
    return df.withColumns({f"{c}_is_missing": null_flag(c) for c, share in shares.items() if share})


def fill(df: DataFrame, values: dict) -> DataFrame:
    """Replace NULL by a value per column; a floating-point number turns any numeric column into double, whatever its value."""
    exprs = {}
    for c, v in values.items():
        dtype = df.schema[c].dataType
        if v is None:
            continue
        if is_numeric(dtype) and isinstance(v, float):
            dtype = T.DoubleType()
        exprs[c] = F.coalesce(quoted(c).cast(dtype), F.lit(v).cast(dtype))
    return df.withColumns(exprs)


def impute_arbitrary(df: DataFrame, columns: Sequence[str], value) -> DataFrame:
    return fill(df, {c: value for c in columns})


def _averages(df: DataFrame, columns: Sequence[str]) -> dict:
    return aggregate_once(df, {c: F.avg(quoted(c).cast("double")) for c in columns})


def impute_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return fill(df, _averages(df, columns))


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return fill(df, {c: q[0] for c, q in quantiles(df, columns, [0.5]).items() if q and q[0] is not None})


def impute_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value; the smallest among ties."""
    return fill(df, modes(df, columns))


def impute_simple(df: DataFrame, columns: Sequence[str], strategy: str = "mean", fill_value=None) -> DataFrame:
    """Strategies mean, median, most_frequent and constant."""
    if strategy == "constant":
        return fill(df, {c: fill_value if fill_value is not None else
                         (0 if is_numeric(df.schema[c].dataType) else "missing_value") for c in columns})
    return {"mean": impute_mean, "median": impute_median, "most_frequent": impute_mode}[strategy](df, columns)


def impute_grouped(df: DataFrame, group_cols: Sequence[str], columns: Sequence[str], method: str = "mean") -> DataFrame:
    """Fill with the statistic of the row's group, or of the whole column where the group has none.

    Text columns always use the mode. Grouping columns are never filled, and rows
    without a group key get the whole-column statistic.
    """
    require_columns(df, [*group_cols, *columns])
    columns = [c for c in columns if c not in group_cols]
    numbers = [c for c in columns if is_numeric(df.schema[c].dataType) and method in ("mean", "median")]
    others = [c for c in columns if c not in numbers]
    group_cols = list(group_cols)
    keyed = df.dropna(subset=group_cols)
    tables, overall = [], {}
    if numbers and method == "mean":
        tables.append(keyed.groupBy(*group_cols).agg(*[F.avg(quoted(c)).alias(f"_g_{c}") for c in numbers]))
        overall |= _averages(df, numbers)
    elif numbers:
        found = grouped_quantiles(keyed, numbers, [0.5], group_cols)
        tables.append(found.groupBy(*group_cols).agg(*[
            F.max(F.when(F.col("column") == c, F.col("quantiles")[0])).alias(f"_g_{c}") for c in numbers]))
        overall |= {c: q[0] if q else None for c, q in quantiles(df, numbers, [0.5]).items()}
    if others:
        found = grouped_modes(keyed, others, group_cols)
        tables.append(found.groupBy(*group_cols).agg(*[F.max(F.when(
            F.col("column") == c, F.col("mode." + mode_field(df.schema[c].dataType)))).alias(f"_g_{c}")
            for c in others]))
        overall |= modes(df, others)
    result = df
    for table in tables:
        result = Lookup(table).attach(result, group_cols)
    exprs = {}
    for c in columns:
        dtype = T.DoubleType() if c in numbers else df.schema[c].dataType
        exprs[c] = F.coalesce(quoted(c).cast(dtype), quoted(f"_g_{c}").cast(dtype), F.lit(overall[c]).cast(dtype))
    return result.withColumns(exprs).select(*[quoted(c) for c in df.columns])


def high_cardinality_keys(df: DataFrame, group_cols: Sequence[str], share: float = 0.5) -> list[str]:
    """Grouping columns with more distinct values than ``share`` of the rows: grouping by them says little."""
    found = aggregate_once(df, {"_n": F.count(F.lit(1)), **{c: F.count_distinct(quoted(c)) for c in group_cols}})
    return [c for c in group_cols if found[c] > share * found["_n"]]


def impute_interpolate_linear(df: DataFrame, column: str, order_by: Sequence[str], direction: str = "forward",
                              limit: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Linear interpolation by row position in ``order_by`` order, within each ``by`` group.

    Forward fills after a known value and carries the last one to the end;
    backward fills before a known value and carries the first one to the start.
    ``limit`` counts the filled values from the known side of each gap. Each slab
    of the ordered table looks at its own rows; what lies beyond its borders comes
    from one summary row per slab.
    """
    if direction not in ("forward", "backward", "both"):
        raise ValueError(f"unknown direction {direction}")
    by = list(by)
    v = quoted(column).cast("double")
    placed = row_positions(df, order_by, by, "_pos", keep_slab=True)
    known = F.when(v.isNotNull(), F.struct(F.col("_pos").alias("p"), v.alias("x")))
    # looking ahead is a running frame in reverse order: frames that end at the last row cost n^2
    inside = Window.partitionBy(*by, "_slab").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    inside_back = Window.partitionBy(*by, "_slab").orderBy(F.desc("_pos")).rowsBetween(Window.unboundedPreceding, 0)
    summary = placed.groupBy(*by, "_slab").agg(F.min("_pos").alias("_start"), F.min(known).alias("_first"),
                                               F.max(known).alias("_last"))
    across, across_back = (Window.partitionBy(*by, F.lit(0)).orderBy(o).rowsBetween(Window.unboundedPreceding, -1)
                           for o in (F.asc("_start"), F.desc("_start")))
    carry = summary.select(
        *[quoted(k) for k in by], "_slab",
        F.last("_last", True).over(across).alias("_carry_prev"),
        F.last("_first", True).over(across_back).alias("_carry_next"))
    if not by:
        carry = F.broadcast(carry)  # one row per slab
    rows = join_on_keys(placed, carry, [*by, "_slab"])
    rows = rows.withColumns({
        "_prev": F.coalesce(F.last(known, True).over(inside), "_carry_prev"),
        "_next": F.coalesce(F.last(known, True).over(inside_back), "_carry_next")})
    prev, nxt, i = F.col("_prev"), F.col("_next"), F.col("_pos")
    line = F.when(prev.isNotNull() & nxt.isNotNull(),
                  prev.x + (nxt.x - prev.x) * (i - prev.p) / F.nullif(nxt.p - prev.p, F.lit(0))).otherwise(
        F.coalesce(prev.x, nxt.x))
    after = prev.isNotNull() if limit is None else prev.isNotNull() & (i - prev.p <= limit)
    before = nxt.isNotNull() if limit is None else nxt.isNotNull() & (nxt.p - i <= limit)
    allowed = {"forward": after, "backward": before, "both": after | before}[direction]
    return rows.withColumn(column, F.coalesce(v, F.when(allowed, line))).select(*[quoted(c) for c in df.columns])


SPLINE_BLOCK = 512  # known points solved together
SPLINE_MARGIN = 48  # neighbours on each side; their influence falls by a factor of 3 or more per point


def _spline_pieces(x: np.ndarray, y: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """Knots and coefficients of the interpolating spline (not-a-knot cubic, midpoint quadratic)."""
    inner = x[2:-2] if degree == 3 else ((x[1:] + x[:-1]) / 2)[1:-1]
    knots = np.concatenate([[x[0]] * (degree + 1), inner, [x[-1]] * (degree + 1)])
    return knots, np.linalg.solve(_spline_basis(x, knots, degree), y)


def _spline_basis(x: np.ndarray, knots: np.ndarray, degree: int) -> np.ndarray:
    """Values of all B-splines at ``x`` by the Cox-de Boor recursion."""
    last = np.searchsorted(knots, knots[-1], side="left") - 1
    span = np.clip(np.searchsorted(knots, x, side="right") - 1, degree, last)
    basis = (np.arange(len(knots) - 1)[None, :] == span[:, None]).astype(float)
    for d in range(1, degree + 1):
        left, right = knots[d:-1] - knots[:-d - 1], knots[d + 1:] - knots[1:-d]
        with np.errstate(divide="ignore", invalid="ignore"):
            a = np.where(left > 0, (x[:, None] - knots[:-d - 1]) / left, 0.0)
            b = np.where(right > 0, (knots[d + 1:] - x[:, None]) / right, 0.0)
        basis = a * basis[:, :-1] + b * basis[:, 1:]
    return basis


def impute_interpolate_spline(df: DataFrame, column: str, order_by: Sequence[str], method: str = "cubic",
                              by: Sequence[str] = ()) -> DataFrame:
    """Fill gaps between known values by the quadratic or cubic spline through all of them.

    The spline depends on far points only beyond rounding, so blocks of known
    points, with a margin from their neighbours, are solved independently and give
    one polynomial per gap; missing rows then look up the polynomial of their gap.
    """
    degree = {"quadratic": 2, "cubic": 3}[method]
    by = list(by)
    v = quoted(column).cast("double")
    placed = row_positions(df, order_by, by, "_pos")
    counted = prefix_sums(placed.withColumn("_known", v.isNotNull().cast("long")), "_known", ["_pos"], by)
    # _before counts the known values strictly before the row: gap j lies between known values j-1 and j
    points = counted.where(v.isNotNull()).select(*[quoted(k) for k in by], F.col("_before").alias("_j"),
                                                 F.col("_pos").cast("double").alias("_x"), v.alias("_y"),
                                                 F.col("_total").alias("_m"))
    spread = points.withColumn("_block", F.explode(F.sequence(
        F.floor(F.greatest(F.col("_j") - SPLINE_MARGIN, F.lit(0)) / SPLINE_BLOCK),
        F.floor((F.least(F.col("_j") + SPLINE_MARGIN, F.col("_m") - 1)) / SPLINE_BLOCK))))
    schema = T.StructType([*[df.schema[k] for k in by], T.StructField("_gap", T.LongType()),
                           T.StructField("_x0", T.DoubleType()),
                           T.StructField("_c", T.ArrayType(T.DoubleType()))])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_j")
        x, y, j = pdf["_x"].to_numpy(), pdf["_y"].to_numpy(), pdf["_j"].to_numpy()
        mine = np.flatnonzero((j[1:] // SPLINE_BLOCK == pdf["_block"].iloc[0]) & (np.diff(x) > 1))
        out = {k: [pdf[k].iloc[0]] * len(mine) for k in by}
        if len(x) <= degree or not len(mine):
            return pd.DataFrame({**{k: out[k][:0] for k in by}, "_gap": pd.Series(dtype="int64"),
                                 "_x0": pd.Series(dtype="float64"), "_c": pd.Series(dtype="object")})
        knots, coef = _spline_pieces(x - x[0], y, degree)
        # a quadratic spline changes piece at the middle of the gap: describe both halves
        u = (x - x[0])[mine]
        width = np.diff(x)[mine]
        halves = []
        for lo in (0.0, 0.5):
            t = u[:, None] + width[:, None] * (lo + 0.5 * (np.arange(degree + 1) + 0.5) / (degree + 1))
            val = (_spline_basis(t.ravel(), knots, degree) @ coef).reshape(t.shape)
            s = (t - u[:, None]) / width[:, None]
            halves.append(np.stack([np.linalg.solve(np.vander(s[i], degree + 1), val[i]) for i in range(len(s))]))
        return pd.DataFrame({**out, "_gap": j[mine + 1].astype("int64"), "_x0": x[mine],
                             "_c": [np.concatenate([a, b, [w]]).tolist()
                                    for a, b, w in zip(halves[0], halves[1], width)]})

    pieces = spread.groupBy(*by, "_block").applyInPandas(solve, schema)
    rows = join_on_keys(counted.withColumn("_gap", F.col("_before")), pieces, [*by, "_gap"], "left")
    n = degree + 1
    s = (F.col("_pos") - F.col("_x0")) / F.col("_c")[2 * n]

    def polynomial(offset: int):
        value = F.col("_c")[offset]
        for i in range(1, n):
            value = value * s + F.col("_c")[offset + i]
        return value
    smooth = F.when(s < 0.5, polynomial(0)).otherwise(polynomial(n))
    return rows.withColumn(column, F.coalesce(v, F.when(F.col("_pos") > F.col("_x0"), smooth))).select(
        *[quoted(c) for c in df.columns])


def impute_random_forest(df: DataFrame, columns: Sequence[str], trees: int = 100, max_depth: int = 5,
                         seed: int = 42) -> DataFrame:
    """Predict missing values from the other numeric columns, whose own gaps take the median of the training rows."""
    result = df
    for c in columns:
        features = numeric_columns(result, exclude=[c])
        train = result.where(quoted(c).isNotNull())
        medians = quantiles(train, features, [0.5])
        filled = result.withColumns({f"_f{i}": F.coalesce(quoted(f).cast("double"), F.lit(
            (medians[f] or [0.0])[0])) for i, f in enumerate(features)})
        names = [f"_f{i}" for i in range(len(features))]
        model = Pipeline(stages=[
            VectorAssembler(inputCols=names, outputCol="_features"),
            RandomForestRegressor(featuresCol="_features", labelCol="_label", predictionCol="_guess", numTrees=trees,
                                  maxDepth=max_depth, seed=seed)]).fit(
            filled.where(quoted(c).isNotNull()).withColumn("_label", quoted(c).cast("double")))
        result = model.transform(filled).withColumn(
            c, F.coalesce(quoted(c).cast("double"), F.col("_guess"))).select(*[quoted(k) for k in df.columns])
        if c != columns[-1]:
            result = checkpointed(result)  # or the next forest would run this one over all rows in each of its passes
    return result


def impute_matrix_factorization(df: DataFrame, columns: Sequence[str] | None = None, rank: int = 3,
                                iterations: int = 30, regularization: float = 0.1, seed: int = 42,
                                tolerance: float = 1e-6) -> DataFrame:
    """Low-rank fit to the observed cells of the (standardised) columns; missing cells take its value.

    Alternating least squares arranged for tables with many rows and few columns:
    row factors are solved where the row is, and only the normal equations of
    the columns, (rank + 1)^2 numbers each, leave a task. A row without any
    observed cell gets the column mean.
    """
    if not columns:
        numbers = numeric_columns(df)
        columns = [c for c, share in missing_shares(df.select(*[quoted(c) for c in numbers])).items() if share]
    columns = list(columns)
    width = len(columns)
    s = aggregate_once(df, {f"{k}{i}": fn(quoted(c).cast("double")) for i, c in enumerate(columns)
                            for k, fn in (("m", F.avg), ("d", F.stddev_pop))})
    centre = [s[f"m{i}"] for i in range(width)]
    spread = [s[f"d{i}"] or 1.0 for i in range(width)]
    scaled = [((quoted(c).cast("double") - centre[i]) / spread[i]).alias(f"z{i}") for i, c in enumerate(columns)]
    cells = df.select(*scaled).persist()
    start = np.random.default_rng(seed).normal(scale=0.1, size=(width, rank))

    def row_factors(z: np.ndarray, v: np.ndarray) -> np.ndarray:
        seen = ~np.isnan(z)
        gram = np.einsum("nc,ca,cb->nab", seen, v, v) + regularization * np.eye(rank)
        return np.linalg.solve(gram, (np.where(seen, z, 0.0) @ v)[..., None])[..., 0]

    def equations(v: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((width, rank, rank + 1))
            for pdf in batches:
                z = pdf.to_numpy(dtype=float)
                if len(z):
                    u, seen = row_factors(z, v), ~np.isnan(z)
                    total[:, :, :rank] += np.einsum("nc,na,nb->cab", seen, u, u)
                    total[:, :, rank] += np.where(seen, z, 0.0).T @ u
            yield pd.DataFrame({"at": np.arange(total.size), "part": total.ravel()})
        return run

    v = start
    for _ in range(iterations):
        parts = cells.mapInPandas(equations(v), "at int, part double").groupBy("at").agg(F.sum("part").alias("part"))
        found = np.zeros(width * rank * (rank + 1))
        for r in parts.collect():  # width * rank * (rank + 1) numbers
            found[r["at"]] = r["part"]
        found = found.reshape(width, rank, rank + 1)
        nxt = np.stack([np.linalg.solve(found[c, :, :rank] + regularization * np.eye(rank), found[c, :, rank])
                        for c in range(width)])
        moved = float(np.abs(nxt - v).max())
        v = nxt
        if moved < tolerance:
            break
    cells.unpersist()
    fitted = v

    @F.pandas_udf("array<double>")
    def rebuild(z: pd.DataFrame) -> pd.Series:
        return pd.Series(list(row_factors(z.to_numpy(dtype=float), fitted) @ fitted.T))

    return df.withColumn("_fit", rebuild(F.struct(*scaled))).withColumns({
        c: F.coalesce(quoted(c).cast("double"), F.col("_fit")[i] * spread[i] + centre[i])
        for i, c in enumerate(columns)}).drop("_fit")


def auto_clean(df: DataFrame, order_by: Sequence[str], threshold_missing: float = 0.7,
               strategy: str = "auto") -> DataFrame:
    """Drop sparse columns, fill numbers, fill the rest with the mode; ``aggressive`` then drops incomplete rows.

    Numbers take the mean, except with ``conservative``, which uses the nearest
    rows. The ``auto`` rule asks for nearest rows one column at a time when a
    tenth or more is missing; a row has no distance without its only value, so
    that again is the mean.
    """
    from tabwright.operators.neighbors import impute_knn
    result = drop_sparse_columns(df, threshold_missing)
    numbers, texts = numeric_columns(result), categorical_columns(result)
    shares = missing_shares(result)
    gaps = [c for c in numbers if shares[c]]
    if gaps:
        result = impute_knn(result, gaps, order_by) if strategy == "conservative" else impute_mean(result, gaps)
    holes = [c for c in texts if shares[c]]
    if holes:
        result = impute_mode(result, holes)
    return drop_missing_rows(result) if strategy == "aggressive" else result


def imputation_comparison(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, statistic, before, after, difference), the missing percentage included."""
    def long(df: DataFrame, side: str) -> DataFrame:
        stats = describe_numeric(df, columns)
        n = df.agg(F.count("*")).first()[0]
        values = {s: F.col(f"`{s}`").cast("double") for s in STATISTICS}
        values["missing_pct"] = (F.lit(n) - F.col("count")) / n * 100
        return melt(stats, values, ["column"], "statistic", side)
    both = long(before, "before").join(long(after, "after"), ["column", "statistic"])
    return both.withColumn("difference", F.col("after") - F.col("before"))


def drop_duplicates(df: DataFrame, order_by: Sequence[str], subset: Sequence[str] | None = None,
                    keep: str | bool = "first") -> DataFrame:
    """One row per ``subset`` value, the first or last in order; ``keep=False`` removes every repeated row.

    The row_number limits are applied before the shuffle, so a value repeated
    without bound still sends only a row or two per task.
    """
    keys = [quoted(c) for c in subset or df.columns]
    forward = Window.partitionBy(*keys).orderBy(*[quoted(c) for c in order_by])
    if keep is False:
        two = df.withColumn("_rn", F.row_number().over(forward)).where(F.col("_rn") <= 2)
        return two.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where(F.col("_n") == 1).drop(
            "_rn", "_n")
    order = forward if keep == "first" else Window.partitionBy(*keys).orderBy(*[quoted(c).desc() for c in order_by])
    return df.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") == 1).drop("_rn")


def duplicate_value_report(before: DataFrame, after: DataFrame, column: str, top: int = 10) -> DataFrame:
    """(value, before, after, removed) of the values that lost most rows.

    A value that lost every row has no count after and is not reported, as with
    the left join this table is defined by.
    """
    b = before.groupBy(quoted(column).alias("value")).agg(F.count("*").alias("before"))
    a = after.groupBy(quoted(column).alias("value")).agg(F.count("*").alias("after"))
    merged = b.where(F.col("value").isNotNull()).join(a, "value", "left").withColumn(
        "removed", F.col("before") - F.col("after"))
    return merged.where(F.col("removed") > 0).orderBy(F.desc("removed"), "value").limit(top)
