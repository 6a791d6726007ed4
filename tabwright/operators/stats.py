"""Statistics that several operators share: counts per value, prefix sums, exact quantiles, modes.

Nothing here needs one task to see a whole column or a whole group. Values are
counted per distinct value first (combined before the shuffle), then range
partitioned, so that a key holding most of the table is spread over many slabs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabwright.functions.columns import is_numeric, melt, quoted
from tabwright.operators.ranks import values_at
from tabwright.session import checkpointed, setting

LOOKUP_ROWS = 100_000  # largest lookup table that is broadcast


def first_row(df: DataFrame) -> dict:
    return df.first().asDict()


def aggregate_once(df: DataFrame, expressions: dict[str, Column], batch: int = 400) -> dict:
    """Scalar aggregates in one pass (a few passes for very wide tables)."""
    items = list(expressions.items())
    result: dict = {}
    for start in range(0, len(items), batch):
        result.update(first_row(df.agg(*[e.alias(n) for n, e in items[start:start + batch]])))
    return result


def slab_count(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """Range partitioned by ``order`` with the slab number stored in ``_slab``.

    The checkpoint fixes the slab of every row, whatever is recomputed later.
    """
    return checkpointed(df.repartitionByRange(slab_count(df), *[quoted(c) for c in order])
                        .withColumn("_slab", F.spark_partition_id()))


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join in which NULL keys match each other; the keys appear once."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & quoted(k).eqNullSafe(quoted(f"_r_{k}"))
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def slab_totals(rows: DataFrame, weight: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, _slab, _inside, _offset, _total): weight inside each slab, in the slabs before it, and of the whole key.

    At most one row per slab and key.
    """
    earlier = Window.partitionBy(*by, F.lit(0)).orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by, F.lit(0))
    slabs = rows.groupBy(*by, "_slab").agg(F.sum(weight).alias("_inside"))
    return slabs.withColumns({"_offset": F.coalesce(F.sum("_inside").over(earlier), F.lit(0)),
                              "_total": F.sum("_inside").over(whole)})


def prefix_sums(df: DataFrame, weight: str, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Add ``_before`` (weight of earlier rows of the same key), ``_total`` and the row's ``_slab``.

    Three steps: weight per slab, running total over the slabs, running total inside each slab.
    """
    by = list(by)
    rows = ranged(df, *by, *order)
    slabs = slab_totals(rows, weight, by).drop("_inside")
    if not by:
        slabs = F.broadcast(slabs)  # one row per slab
    joined = join_on_keys(rows, slabs, [*by, "_slab"])
    inside = Window.partitionBy(*by, "_slab").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn("_before", F.col("_offset") + F.coalesce(F.sum(weight).over(inside), F.lit(0))).drop(
        "_offset")


def row_positions(df: DataFrame, order_by: Sequence[str], by: Sequence[str] = (), name: str = "position",
                  keep_slab: bool = False) -> DataFrame:
    """0-based position of each row in ``order_by`` order (per ``by``); the order must be total."""
    placed = (prefix_sums(df.withColumn("_one", F.lit(1).cast("long")), "_one", order_by, by)
              .withColumnRenamed("_before", name).drop("_one", "_total"))
    return placed if keep_slab else placed.drop("_slab")


def value_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, column, value, n) of the non-null numeric values."""
    cells = melt(df, {c: quoted(c).cast("double") for c in columns}, by)
    return cells.where(F.col("value").isNotNull()).groupBy(*by, "column", "value").agg(F.count("*").alias("n"))


def average_ranks(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean rank of each distinct value, from (by, value, n)."""
    return prefix_sums(cells, "n", ["value"], by).withColumn("rank", F.col("_before") + (F.col("n") + 1) / 2)


def grouped_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float],
                      by: Sequence[str] = ()) -> DataFrame:
    """(by, column, quantiles): exact quantiles with linear interpolation; NULL for a group without values.

    Whole columns are searched by cuts (see ``ranks``). Of groups, values are counted, range partitioned and summed up per slab. The ranks of the
    probabilities then become rows of the slab they fall into, and one running pass
    over the slab gives each the value at its place. Other slabs are not read again.
    """
    if not by:
        found = quantiles(df, columns, probabilities)
        return df.sparkSession.createDataFrame([(c, found[c]) for c in found], "column string, quantiles array<double>")
    keys = [*by, "column"]
    cells = melt(df, {c: quoted(c).cast("double") for c in columns}, by)
    # the missing values of a group count 0, but keep the group
    counted = ranged(cells.groupBy(*keys, "value").agg(F.count("value").alias("n")), *keys, "value")
    slabs = slab_totals(counted, "n", keys)
    place, rank = F.col("_p") * (F.col("_total") - 1), F.col("_end._rank")
    wanted = slabs.select("*", F.posexplode(F.lit([float(p) for p in probabilities])).alias("_i", "_p")).select(
        *[quoted(k) for k in keys], "_slab", "_offset", "_inside", "_i", (place - F.floor(place)).alias("_part"),
        F.explode(F.array(F.struct(F.lit(False).alias("_upper"), F.floor(place).alias("_rank")),
                          F.struct(F.lit(True).alias("_upper"), F.ceil(place).alias("_rank")))).alias("_end")).where(
        (rank >= F.col("_offset")) & (rank < F.col("_offset") + F.col("_inside")))
    slab = Window.partitionBy(*keys, "_slab")
    hit = join_on_keys(counted.where(F.col("value").isNotNull()),
                       wanted.groupBy(*keys, "_slab", "_offset").agg(F.lit(1).alias("_hit")), [*keys, "_slab"])
    before = F.coalesce(F.sum("n").over(slab.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    both = hit.select(*[quoted(k) for k in keys], "_slab", (F.col("_offset") + before).alias("_rank"), "value").unionByName(
        wanted.select(*[quoted(k) for k in keys], "_slab", rank.alias("_rank"), "_i", "_part", "_end._upper"), True)
    here = F.last("value", True).over(slab.orderBy("_rank", F.col("_i").isNotNull()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow))
    ends = both.withColumn("value", here).where(F.col("_i").isNotNull()).groupBy(*keys, "_i").agg(
        F.max("_part").alias("_part"), F.max(F.when(~F.col("_upper"), F.col("value"))).alias("_low"),
        F.max(F.when(F.col("_upper"), F.col("value"))).alias("_high"))
    step = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(
        F.col("_low") + F.col("_part") * (F.col("_high") - F.col("_low")))
    found = ends.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_i", step.alias("q")))).getField("q").alias("quantiles"))
    empty = slabs.where(F.col("_total") == 0).select(*[quoted(k) for k in keys]).distinct()
    return found.unionByName(empty.withColumn("quantiles", F.lit(None).cast("array<double>")))


def quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> dict[str, list[float] | None]:
    """Exact quantiles of whole columns with linear interpolation, as driver scalars; None without values."""
    columns = list(dict.fromkeys(columns))

    def ranks(total: int) -> list[int]:
        places = [p * (total - 1) for p in probabilities]
        return [math.floor(x) for x in places] + [math.ceil(x) for x in places]

    def quantile(found: dict[int, float], place: float) -> float:
        low, high = found[math.floor(place)], found[math.ceil(place)]
        return low if low == high or math.isnan(low) else low + (place - math.floor(place)) * (high - low)
    result = {}
    for c, (total, found) in values_at(df.select(*[quoted(c) for c in columns]), columns, ranks).items():
        result[c] = [quantile(found, float(p) * (total - 1)) for p in probabilities] if total else None
    return result


def mode_field(dtype: T.DataType) -> str:
    """Field of a ``mode`` struct that holds the modes of columns of this type."""
    if isinstance(dtype, T.DecimalType):
        return f"decimal_{dtype.precision}_{dtype.scale}"
    if not is_numeric(dtype):
        return "text"
    return "number" if isinstance(dtype, T.FractionalType) else "whole"


def grouped_modes(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, column, mode, n): most frequent value, the smallest among ties.

    ``mode`` is a struct with one field per kind of type, so that no value is rounded; ``mode_field`` names a column's.
    """
    fields = {c: mode_field(df.schema[c].dataType) for c in columns}
    carriers = {"text": "string", "number": "double", "whole": "bigint"}
    carriers |= {fields[c]: df.schema[c].dataType.simpleString() for c in columns if fields[c] not in carriers}
    used = [f for f in carriers if f in fields.values()]
    cells = melt(df.select(*[quoted(c) for c in dict.fromkeys([*by, *columns])]), {
        c: F.when(quoted(c).isNotNull(), F.struct(*[(quoted(c) if f == fields[c] else F.lit(None)).cast(carriers[f]).alias(f)
                                                    for f in used])) for c in columns}, by)
    counted = cells.where(F.col("value").isNotNull()).groupBy(*by, "column", "value").agg(F.count("*").alias("n"))
    best = counted.groupBy(*by, "column").agg(F.min(F.struct((-F.col("n")).alias("k"), F.col("value"))).alias("b"))
    return best.select(*[quoted(k) for k in by], "column", F.col("b.value").alias("mode"), (-F.col("b.k")).alias("n"))


def modes(df: DataFrame, columns: Sequence[str]) -> dict:
    found = {r["column"]: r["mode"][mode_field(df.schema[r["column"]].dataType)] for r in grouped_modes(df, columns).collect()}
    return {c: found.get(c) for c in columns}


class Lookup:
    """A table joined to a larger one: broadcast when its measured size allows, else shuffled."""

    def __init__(self, table: DataFrame):
        spark = table.sparkSession
        limit = setting(spark, "lookup.maxRows", LOOKUP_ROWS)
        head = table.limit(limit + 1).toArrow()
        self.small = head.num_rows <= limit
        self.table = spark.createDataFrame(head, schema=table.schema) if self.small else checkpointed(table)

    def attach(self, df: DataFrame, on: Sequence[str], how: str = "left", null_safe: bool = False) -> DataFrame:
        side = F.broadcast(self.table) if self.small else self.table
        return join_on_keys(df, side, on, how) if null_safe else df.join(side, list(on), how)


def dense_codes(values: DataFrame, order_by: Sequence[str], name: str = "code") -> Lookup:
    """Number the rows of a table of distinct values 0, 1, ... in ``order_by`` order."""
    table = Lookup(values)
    if table.small:
        table.table = table.table.withColumn(
            name, (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order_by)) - 1).cast("long"))
        return table
    return Lookup(row_positions(table.table, order_by, name=name))
