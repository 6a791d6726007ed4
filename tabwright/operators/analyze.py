"""The tables behind exploratory charts."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi, sqrt

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window, functions as F

from tabwright.functions.columns import as_double, correlation, is_numeric, melt, numeric_columns, quoted, require_columns
from tabwright.operators.missing import column_pairs
from tabwright.operators.profile import describe_numeric
from tabwright.operators.stats import Lookup, aggregate_once, grouped_quantiles, row_positions

WHISKER = 1.5


def line_series(df: DataFrame, x: str, ys: Sequence[str]) -> DataFrame:
    """(x, series, y) in x order."""
    return melt(df, {y: quoted(y).cast("double") for y in ys}, [x], "series", "y").orderBy(quoted(x), "series")


def box_stats(df: DataFrame, value: str, by: Sequence[str] = (), k: float = WHISKER) -> DataFrame:
    """(by, min, q1, median, q3, max, lower and upper whisker, outliers, n) per group.

    A whisker ends at the outermost value within ``k`` interquartile ranges of the box.
    """
    keys = list(by) or ["_all"]
    rows = (df if by else df.withColumn("_all", F.lit(0))).select(
        *[quoted(c) for c in keys], quoted(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    q = F.col("quantiles")
    five = ["min", "q1", "median", "q3", "max"]
    boxes = Lookup(grouped_quantiles(rows, ["_v"], [0.0, 0.25, 0.5, 0.75, 1.0], keys).select(
        *[quoted(c) for c in keys], *[q[i].alias(n) for i, n in enumerate(five)],
        (q[1] - k * (q[3] - q[1])).alias("_low"), (q[3] + k * (q[3] - q[1])).alias("_high")))
    inside = (F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high"))
    return boxes.attach(rows, keys, "inner", null_safe=True).groupBy(*[quoted(c) for c in keys]).agg(
        *[F.max(c).alias(c) for c in five],
        F.min(F.when(inside, F.col("_v"))).alias("lower_whisker"),
        F.max(F.when(inside, F.col("_v"))).alias("upper_whisker"),
        F.count_if(~inside).alias("outliers"), F.count("*").alias("n")).drop("_all")


def pie_counts(df: DataFrame, category: str, target: str) -> DataFrame:
    """(category, target, n, share): share of each target value inside its category."""
    counts = df.dropna(subset=[category, target]).groupBy(quoted(category), quoted(target)).agg(
        F.count("*").alias("n"))
    total = counts.groupBy(quoted(category)).agg(F.sum("n").alias("_t"))
    return counts.join(total, category).withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def scatter_matrix(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], points: int | None = None) -> DataFrame:
    """(x_column, y_column, x, y) of every column pair; ``points`` keeps an evenly spaced sample of rows."""
    rows = df
    if points:
        n = df.count()
        if n > points:
            rows = row_positions(df, order_by).where(F.col("position") % max(1, n // points) == 0)
    pairs = [F.struct(F.lit(a).alias("x_column"), F.lit(b).alias("y_column"), quoted(a).cast("double").alias("x"),
                      quoted(b).cast("double").alias("y")) for a in columns for b in columns if a != b]
    return rows.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


def crosstab_counts(df: DataFrame, x: str, y: str, values: Sequence | None = None) -> DataFrame:
    """Counts of x by y, one column per y value, 0 where a pair never occurs.

    Without given ``values`` and with more than 1 000 of them in y, the pairs that occur come as rows (x, y, n).
    """
    if values is None:
        values = sorted(r[0] for r in df.select(quoted(y)).where(quoted(y).isNotNull()).distinct().limit(1001).collect())
        if len(values) > 1000:
            return df.dropna(subset=[x, y]).groupBy(quoted(x), quoted(y)).agg(F.count(F.lit(1)).alias("n"))
    return df.dropna(subset=[x, y]).groupBy(quoted(x)).pivot(y, list(values)).agg(F.count(F.lit(1))).fillna(0)


def bar_values(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, sum, mean, min, max, count) of y."""
    v = quoted(y)
    return df.groupBy(quoted(x)).agg(F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.min(v).alias("min"),
                                     F.max(v).alias("max"), F.count(v).alias("count"))


def count_values(df: DataFrame, column: str) -> DataFrame:
    """(value, n) without missing values, most frequent first."""
    return df.where(quoted(column).isNotNull()).groupBy(quoted(column).alias("value")).agg(
        F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def histogram_density(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """(column, bin, left, right, n, density) with equal-width bins from the minimum to the maximum."""
    edge = aggregate_once(df, {f"{k}{i}": fn(quoted(c).cast("double")) for i, c in enumerate(columns)
                               for k, fn in (("lo", F.min), ("hi", F.max), ("n", F.count))})
    cells, slots = {}, []
    for i, c in enumerate(columns):
        lo, hi, n = edge[f"lo{i}"], edge[f"hi{i}"], edge[f"n{i}"]
        if not n:
            continue
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        width = (hi - lo) / bins
        x = quoted(c).cast("double")
        cells[c] = F.when(x >= hi, bins - 1).otherwise(F.floor((x - lo) / width)).cast("int")
        slots += [(c, b, lo + b * width, lo + (b + 1) * width, n, width) for b in range(bins)]
    counts = melt(df, cells, name="column", value="bin").where(F.col("bin").isNotNull()).groupBy(
        "column", "bin").agg(F.count("*").alias("k"))
    table = df.sparkSession.createDataFrame(
        slots, "column string, bin int, left double, right double, total long, width double")
    return table.join(counts, ["column", "bin"], "left").select(
        "column", "bin", "left", "right", F.coalesce("k", F.lit(0)).cast("long").alias("n"),
        (F.coalesce("k", F.lit(0)) / (F.col("total") * F.col("width"))).alias("density"))


def kernel_density(df: DataFrame, column: str, points: int = 200, bandwidth: float | None = None) -> DataFrame:
    """(x, density): Gaussian kernel estimate with Scott's bandwidth on an even grid.

    Rows are counted per distinct value first; one aggregate then holds a sum per grid point.
    """
    x = quoted(column).cast("double")
    s = aggregate_once(df, {"n": F.count(x), "d": F.stddev_samp(x), "lo": F.min(x), "hi": F.max(x)})
    h = bandwidth or (s["n"] ** -0.2) * s["d"]
    grid = [s["lo"] + (s["hi"] - s["lo"]) * i / (points - 1) for i in range(points)]
    counted = df.where(x.isNotNull()).groupBy(x.alias("v")).agg(F.count("*").alias("n"))
    norm = s["n"] * h * sqrt(2 * pi)
    wide = counted.agg(*[(F.sum(F.col("n") * F.exp(-0.5 * F.pow((F.lit(g) - F.col("v")) / h, F.lit(2)))) / norm).alias(f"d{i}")
                         for i, g in enumerate(grid)])
    places = F.array(*[F.struct(F.lit(g).alias("x"), F.col(f"d{i}").alias("density")) for i, g in enumerate(grid)])
    return wide.select(F.inline(places))


def scatter_points(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(quoted(x).alias("x"), quoted(y).alias("y"))


def scatter_3d(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """(x, y, z); a text column is no z axis."""
    if not is_numeric(df.schema[z].dataType):
        raise ValueError(f"{z} is not numeric")
    return df.select(quoted(x).alias("x"), quoted(y).alias("y"), as_double(df, z).alias("z"))


def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_a, column_b, correlation): Pearson of each column pair over the rows that have both."""
    columns = list(columns or numeric_columns(df))

    return column_pairs(df, columns, lambda a, b: correlation(quoted(a).cast("double"), quoted(b).cast("double")),
                        "correlation")


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Square form of ``correlation_pairs``: one row per column."""
    columns = list(columns or numeric_columns(df))
    pairs = correlation_pairs(df, columns)
    flipped = pairs.select(F.col("column_b").alias("column_a"), F.col("column_a").alias("column_b"), "correlation")
    moments = df.agg(*[(F.stddev_pop(quoted(c).cast("double")) > 0).alias(c) for c in columns])
    own = melt(moments, {c: F.when(quoted(c), 1.0) for c in columns}, name="column_a", value="correlation").select(
        "column_a", F.col("column_a").alias("column_b"), "correlation")
    return pairs.union(flipped).union(own).groupBy(F.col("column_a").alias("column")).pivot(
        "column_b", columns).agg(F.max("correlation"))


def top_correlations(df: DataFrame, columns: Sequence[str] | None = None, top: int | None = None) -> DataFrame:
    """Column pairs by the size of their correlation."""
    ordered = correlation_pairs(df, columns).where(F.col("correlation").isNotNull()).orderBy(
        F.abs("correlation").desc(), "column_a", "column_b")
    return ordered.limit(top) if top else ordered


AGGREGATES = {"mean": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
# interval -> (unit truncated to, step between bins)
INTERVALS = {"D": ("day", "1 day"), "W": ("week", "7 days"), "M": ("month", "1 month"), "Q": ("quarter", "3 months"),
             "Y": ("year", "1 year")}


def time_resample(df: DataFrame, time: str, value: str, interval: str = "D", how: str = "mean") -> DataFrame:
    """(bin, value) for every bin from the first to the last, empty ones included.

    Days are labelled by their date, weeks by the Sunday that ends them, longer
    bins by their last day. Empty bins sum and count to 0; their mean, min and max are missing.
    """
    unit, step = INTERVALS[interval]
    moment = quoted(time)
    if dict(df.dtypes)[time] == "string":
        moment = F.try_to_timestamp(moment)
    start = F.date_trunc(unit, moment).cast("date")
    binned = df.where(moment.isNotNull()).groupBy(start.alias("_start")).agg(AGGREGATES[how](quoted(value)).alias("value"))
    calendar = binned.agg(F.min("_start").alias("a"), F.max("_start").alias("b")).select(
        F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {step}"))).alias("_start"))
    label = {"D": F.col("_start"), "W": F.date_add("_start", 6), "M": F.last_day("_start"),
             "Q": F.last_day(F.add_months("_start", 2)), "Y": F.last_day(F.add_months("_start", 11))}[interval]
    filled = F.coalesce("value", F.lit(0)) if how in ("sum", "count") else F.col("value")
    return calendar.join(binned, "_start", "left").select(label.alias("bin"), filled.alias("value"))


def rolling_mean_7(bins: DataFrame, interval: str = "D", window: int = 7) -> DataFrame:
    """(bin, value, rolling): mean of each bin and the ``window - 1`` before it; missing until all are there.

    Each bin is added to the windows it belongs to, so no task needs the whole series.
    """
    step = {"D": 1, "W": 7}.get(interval)
    months = {"M": 1, "Q": 3, "Y": 12}.get(interval)
    shift = F.explode(F.sequence(F.lit(0), F.lit(window - 1)))
    moved = bins.where(F.col("value").isNotNull()).select("bin", "value", shift.alias("_k"))
    target = (F.date_add("bin", F.col("_k") * step) if step
              else F.last_day(F.add_months("bin", F.col("_k") * months)))
    sums = moved.groupBy(target.alias("bin")).agg(F.count("*").alias("_c"), F.avg("value").alias("_m"))
    return bins.join(sums, "bin", "left").select("bin", "value", F.when(F.col("_c") == window, F.col("_m")).alias("rolling"))


def distribution_compare(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Histograms of several columns side by side."""
    if not columns:
        raise ValueError("select at least one column")
    return histogram_density(df, columns, bins)


def cohort_retention(df: DataFrame, date: str, user: str, value: str, metric: str = "value") -> DataFrame:
    """(cohort, cohort_index, mean_value, retention): months since a user's first one.

    Retention is the mean value of a month over that of month 0; with
    ``metric='users'`` it is the share of the cohort's users seen. Rows are first
    reduced to one per user and month, so a very active user weighs no more than others.
    """
    monthly = df.select(quoted(user).alias("_u"), F.trunc(quoted(date), "MM").alias("_m"), quoted(value).alias("_v")).where(
        F.col("_m").isNotNull() & F.col("_u").isNotNull()).groupBy("_u", "_m").agg(
        F.sum("_v").alias("_s"), F.count("_v").alias("_c"))
    first = monthly.withColumn("cohort", F.min("_m").over(Window.partitionBy("_u")))
    index = (F.year("_m") - F.year("cohort")) * 12 + F.month("_m") - F.month("cohort")
    cells = first.groupBy("cohort", index.alias("cohort_index")).agg(
        F.try_divide(F.sum("_s"), F.sum("_c")).alias("mean_value"), F.count("*").alias("users"))
    measure = F.col("mean_value" if metric == "value" else "users")
    base = F.max(F.when(F.col("cohort_index") == 0, measure)).over(Window.partitionBy("cohort"))
    return cells.withColumn("retention", F.try_divide(measure, base))


def funnel(df: DataFrame, stages: Sequence[str]) -> DataFrame:
    """(position, stage, count, percentage, conversion): share of all rows, and of the stage before."""
    require_columns(df, stages)
    wide = df.agg(F.count("*").alias("_n"), *[F.sum(quoted(s).cast("double")).alias(f"s{i}") for i, s in enumerate(stages)])
    rows = F.array(*[F.struct(
        F.lit(i).alias("position"), F.lit(s).alias("stage"), F.col(f"s{i}").alias("count"),
        F.try_divide(F.col(f"s{i}"), F.col("_n")).alias("_p"),
        (F.try_divide(F.col(f"s{i}"), F.col(f"s{i - 1}")) if i else F.lit(None).cast("double")).alias("_c"))
        for i, s in enumerate(stages)])
    return wide.select(F.explode(rows).alias("r")).select(
        "r.position", "r.stage", "r.count", (F.col("r._p") * 100).alias("percentage"),
        (F.col("r._c") * 100).alias("conversion"))


def segment_kmeans(df: DataFrame, features: Sequence[str], clusters: int = 3, seed: int = 42) -> DataFrame:
    """Add ``Cluster``."""
    assembled = VectorAssembler(inputCols=list(features), outputCol="_features").transform(df)
    model = KMeans(k=clusters, seed=seed, featuresCol="_features", predictionCol="Cluster").fit(assembled)
    return model.transform(assembled).drop("_features")


def cluster_stats(df: DataFrame, features: Sequence[str], cluster: str = "Cluster") -> DataFrame:
    return describe_numeric(df, features, [cluster])


def sort_rows(df: DataFrame, columns: Sequence[str], ascending: bool = True) -> DataFrame:
    return df.orderBy(*[quoted(c) for c in columns], ascending=ascending)


def group_mean_count(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, mean, n)."""
    return df.groupBy(quoted(by)).agg(F.avg(quoted(value)).alias("mean"), F.count("*").alias("n"))


def top10_values(df: DataFrame, column: str) -> DataFrame:
    return count_values(df, column).limit(10)
