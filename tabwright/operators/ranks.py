"""Values at given ranks of whole columns, exactly, without sorting the columns.

Sketches only propose cuts. Every pass counts the values at and between the cuts, so the part of a column that
holds a rank is known for certain; it gets finer cuts, until the parts left hold few enough values to gather them.
A pass reads the rows once and shuffles sketches or counts, never rows. Neither heavy ties (a tie becomes a cut)
nor a wrong sketch (one more pass) changes a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tabwright.functions.columns import melt, quoted
from tabwright.session import setting

ACCURACY = 1_000     # a sketch misses a rank by at most one in so many of its values
GRID = 500           # steps of equal share that are read off a sketch
SLICES = 200         # sketches of one part are merged in so many tasks at most
GATHERED = 500_000   # distinct values gathered on the driver in a pass,
PER_RANK = 1_000     # or so many for each rank searched, if that is more
SPELLED = 24         # cuts of a column that are compared one by one in SQL; more are searched by batches of values
HELD = 1_000_000     # distinct values that a task holds before it sends them on
PASSES = 30


@dataclass
class Search:
    """State of one column: ``cuts`` split its values into parts, number 2i + 1 at cut i and the even ones between."""

    cuts: list[float] = field(default_factory=list)
    fine: set[int] = field(default_factory=lambda: {0})  # parts whose values the next pass looks into
    about: float = np.inf                                # values expected in them
    total: int = 0
    left: list[int] = field(default_factory=list)
    found: dict[int, float] = field(default_factory=dict)

    def part(self, value: Column) -> Column:
        """Number of the part that holds a value; -1 - number where only the count matters. NaN lies after all others."""
        def code(number: int) -> int:
            return number if number in self.fine else -1 - number

        def pick(a: int, b: int) -> Column:
            if a == b:
                return F.lit(code(2 * a))
            mid = (a + b) // 2
            return F.when(value < self.cuts[mid], pick(a, mid)).when(
                value == self.cuts[mid], F.lit(code(2 * mid + 1))).otherwise(pick(mid + 1, b))
        return pick(0, len(self.cuts))

    def settle(self, counts: dict[int, int], inside: dict[int, tuple[np.ndarray, np.ndarray]], exact: bool) -> None:
        """Place the ranks among the counted parts; ``inside`` has the sorted values and weights of the fine ones."""
        parts = sorted(counts)
        ends = np.cumsum([counts[p] for p in parts])
        cuts, spans, about, open_ranks = set(), [], 0.0, []
        for rank in self.left:
            at = int(np.searchsorted(ends, rank, side="right"))
            if at == len(parts):
                raise RuntimeError("the rows differ from one reading to the next")
            part, size = parts[at], counts[parts[at]]
            within = rank - (int(ends[at]) - size)
            if part % 2:
                self.found[rank] = self.cuts[part // 2]
            elif self.cuts and part == 2 * len(self.cuts) and self.cuts[-1] == np.inf:
                self.found[rank] = float("nan")
            elif part in inside and exact:
                values, weights = inside[part]
                self.found[rank] = float(values[np.searchsorted(np.cumsum(weights), within, side="right")])
            else:
                open_ranks.append(rank)
                low = self.cuts[part // 2 - 1] if part else None
                high = self.cuts[part // 2] if part < 2 * len(self.cuts) else None
                cuts.update(c for c in (low, high) if c is not None)
                if part in inside:
                    values, weights = inside[part]
                    sums = np.cumsum(weights)
                    margin = size * (1 / GRID + 1 / ACCURACY) + len(values) // GRID  # a value of each slice
                    a, b = np.searchsorted(sums, [within - margin, within + margin])
                    low = float(values[a - 1]) if a else low
                    high = float(values[b]) if b < len(values) else high
                    cuts.update(c for c in (low, high) if c is not None)
                    size = 1 if low == high and low is not None else min(size, 3 * margin)
                spans.append((low, high))
                about += size
        self.left, self.cuts, self.about, self.fine = open_ranks, sorted(cuts), about, set()
        for low, high in set(spans):
            first = 0 if low is None else int(np.searchsorted(self.cuts, low)) + 1
            last = len(self.cuts) if high is None else int(np.searchsorted(self.cuts, high))
            self.fine.update(range(2 * first, 2 * last + 1, 2))


def _cells(df: DataFrame, columns: Sequence[str], searches: dict[int, Search], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, column, part, value): every value that is not NULL; the value is kept in fine parts alone."""
    pairs = {}
    for i, s in searches.items():
        value = quoted(columns[i]).cast("double")
        pairs[i] = F.when(value.isNotNull(), F.struct(s.part(value).alias("part"), value.alias("value")))
    cells = melt(df, pairs, keys, value="cell").where("cell is not null").select(*keys, "column", "cell.part", "cell.value")
    return cells.withColumn("value", F.when(F.col("part") >= 0, F.col("value")))


def _many_cuts(searches: dict[int, Search]) -> bool:
    return any(len(s.cuts) > SPELLED for s in searches.values())


def _summed_cells(df: DataFrame, columns: Sequence[str], searches: dict[int, Search], slices: int, merge: bool) -> DataFrame:
    """(_slice, column, part, value, n): the same cells with the parts counted by task, for columns of many cuts.

    With ``merge``, equal values of fine parts are counted by task as well; otherwise each is a row.
    """
    order = list(searches)
    cuts = [np.array(searches[i].cuts, float) for i in order]
    fine = [np.isin(np.arange(2 * len(c) + 1), list(searches[i].fine)) for i, c in zip(order, cuts)]

    def part(at: int, values: np.ndarray) -> np.ndarray:
        n = np.searchsorted(cuts[at], values)
        return 2 * n + (np.append(cuts[at], np.nan)[n] == values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() % slices
        counts = [np.zeros(len(f), np.int64) for f in fine]
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in order]
        size, distinct = 0, 0

        def rows(at: int, parts: np.ndarray, values: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "_slice": pa.array(np.full(len(n), number, np.int32)), "column": pa.array(np.full(len(n), order[at], np.int32)),
                "part": pa.array(parts.astype(np.int32)), "value": pa.nulls(len(n), pa.float64()) if values is None else pa.array(values),
                "n": pa.array(n.astype(np.int64))})

        def squeeze() -> int:
            for at, found in enumerate(held):
                if found:
                    values, n = (np.concatenate(x) for x in zip(*found))
                    values, place = np.unique(values, return_inverse=True)
                    held[at] = [(values, np.bincount(place, n, len(values)))]
            return sum(len(found[0][0]) for found in held if found)

        def sent() -> Iterator[pa.RecordBatch]:
            for at, found in enumerate(held):
                for values, n in found:
                    yield rows(at, part(at, values), values, n)
                held[at] = []
        for b in batches:
            for at in range(len(order)):
                values = b.column(at).drop_null().to_numpy(zero_copy_only=False)
                parts = part(at, values)
                inside = fine[at][parts]
                counts[at] += np.bincount(parts[~inside], minlength=len(fine[at]))
                values = values[inside]
                if merge:
                    held[at].append((values, np.ones(len(values))))
                    size += len(values)
                elif len(values):
                    yield rows(at, parts[inside], values, np.ones(len(values)))
            if size > distinct + HELD:
                size = distinct = squeeze()
                if distinct > HELD:
                    yield from sent()
                    size = distinct = 0
        squeeze()
        yield from sent()
        for at, n in enumerate(counts):
            if n.any():
                yield rows(at, -1 - np.flatnonzero(n), None, n[n > 0])
    table = df.select(*[quoted(columns[i]).cast("double").alias(f"_{i}") for i in order])
    return table.mapInArrow(run, "_slice int, column int, part int, value double, n long")


Seen = list[tuple[Search, dict[int, int], dict[int, tuple[np.ndarray, np.ndarray]]]]


def _sketch(df: DataFrame, columns: Sequence[str], searches: dict[int, Search]) -> Seen:
    """Counts per part, and values of equal steps with their weights for the fine ones."""
    groups = max(1, sum(len(s.fine) for s in searches.values()))
    slices = max(8, min(SLICES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) // groups)
    if _many_cuts(searches):
        cells, n = _summed_cells(df, columns, searches, slices, False), F.sum("n")
    else:
        cells, n = _cells(df.withColumn("_slice", F.spark_partition_id() % slices), columns, searches, ["_slice"]), F.count("*")
    plain = F.when(F.isnan("value"), F.lit(float("inf"))).otherwise(F.col("value"))
    table = cells.groupBy("_slice", "column", "part").agg(
        n.alias("n"), F.percentile_approx(plain, [i / GRID for i in range(GRID + 1)], ACCURACY).alias("grid")).toArrow()
    counts: dict[int, dict[int, int]] = {i: {} for i in searches}
    grids: dict[int, dict[int, list]] = {i: {} for i in searches}
    for i, part, n, grid in zip(*(table.column(c) for c in ("column", "part", "n", "grid"))):
        i, part, n = i.as_py(), part.as_py(), n.as_py()
        number = part if part >= 0 else -1 - part
        counts[i][number] = counts[i].get(number, 0) + n
        if part >= 0:
            grids[i].setdefault(number, []).append((grid.values.to_numpy(), n))
    result = []
    for i, s in searches.items():
        inside = {}
        for number, found in grids[i].items():
            values = np.concatenate([g for g, _ in found])
            weights = np.concatenate([np.full(len(g), n / len(g)) for g, n in found])
            order = np.argsort(values, kind="stable")
            inside[number] = (values[order], weights[order])
        result.append((s, counts[i], inside))
    return result


def _gather(df: DataFrame, columns: Sequence[str], searches: dict[int, Search], limit: int) -> Seen | None:
    """Counts per part, and per distinct value of the fine ones; None if these are more than ``limit``."""
    if _many_cuts(searches):
        cells, n = _summed_cells(df, columns, searches, 1, True), F.sum("n")
    else:
        cells, n = _cells(df, columns, searches), F.count("*")
    counted = cells.groupBy("column", "part", "value").agg(n.alias("n"))
    table = counted.limit(limit + 1).toArrow()
    if table.num_rows > limit:
        return None
    column, part, value, n = (table.column(c).to_numpy() for c in ("column", "part", "value", "n"))
    value = value.astype(float)
    order = np.lexsort((value, part, column))
    column, part, value, n = column[order], part[order], value[order], n[order]
    starts = np.flatnonzero(np.r_[True, (column[1:] != column[:-1]) | (part[1:] != part[:-1])]) if len(column) else []
    counts: dict[int, dict[int, int]] = {i: {} for i in searches}
    inside: dict[int, dict[int, tuple]] = {i: {} for i in searches}
    for a, b in zip(starts, [*starts[1:], len(column)]):
        i, number = int(column[a]), int(part[a])
        counts[i][number if number >= 0 else -1 - number] = int(n[a:b].sum())
        if number >= 0:
            inside[i][number] = (value[a:b], n[a:b])
    return [(s, counts[i], inside[i]) for i, s in searches.items()]


def values_at(df: DataFrame, columns: Sequence[str],
              ranks: Callable[[int], Sequence[int]]) -> dict[str, tuple[int, dict[int, float]]]:
    """Per column its number of values and, for each of ``ranks(number)``, counted from 0, the value there.

    NULL has no rank; NaN comes after infinity. ``df`` is read two or more times and must give the same rows.
    """
    limit = setting(df.sparkSession, "ranks.gathered", GATHERED)
    searches = {i: Search() for i in range(len(columns))}
    for s, counts, inside in _sketch(df, columns, searches):
        s.total = sum(counts.values())
        s.left = sorted(set(ranks(s.total))) if s.total else []
        s.settle(counts, inside, False)
    for _ in range(PASSES):
        left = {i: s for i, s in searches.items() if s.left}
        if not left:
            return {c: (searches[i].total, searches[i].found) for i, c in enumerate(columns)}
        seen, room = None, max(limit, PER_RANK * sum(len(s.left) for s in left.values()))
        if sum(s.about for s in left.values()) <= room:
            seen = _gather(df, columns, left, room)
        exact = seen is not None
        for s, counts, inside in seen if exact else _sketch(df, columns, left):
            s.settle(counts, inside, exact)
    raise RuntimeError("the rows differ from one reading to the next")
