"""Trees of tables with few distinct bins: rows that lie in the same bins are indistinguishable to a tree, so they count as one.

Features are cut at quantiles into at most ``N_BINS`` bins, as tree learners do anyway. A cell is a combination of bins that
occurs; the table is read once to sum up its cells, and what follows does not grow with the rows.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import ceil, exp, factorial, log2, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from tabwright.functions.columns import none_missing, quoted
from tabwright.operators.models import trees
from tabwright.operators.models.recipe import LABEL, Task, projection, scaled_names, sql_number
from tabwright.operators.models.trees import Spec
from tabwright.session import checkpointed, setting

N_BINS = 32
MOST_FEATURES = 12  # whose bins together make a whole number of 60 bits
FOREST_CELLS = 16_384  # of which each task sums up those of all trees

CUT_CELLS = 4_000_000  # of one tree with cuts of its own, which a task holds
HELD_CELLS = 4_000_000  # of all trees, that a task sums up before it sends them on


@dataclass(frozen=True)
class Bins:
    names: list[str]
    edges: list[list[float]]

    def columns(self) -> list[str]:
        """The bin of each feature: the number of edges below its value."""
        return [f"CAST(size(filter(array({', '.join(sql_number(e) for e in edges)}), c -> c < `{n}`)) AS DOUBLE)" if edges else "0D"
                for n, edges in zip(self.names, self.edges)]

    def stages(self) -> list[Transformer]:
        parts = [projection(", ".join(f"{c} AS _bin_{i}" for i, c in enumerate(self.columns())))]
        return [*parts, VectorAssembler(inputCols=[f"_bin_{i}" for i in range(len(self.names))], outputCol="_bins")]

    def cell(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_cell", F.expr(" + ".join(f"CAST({c} AS BIGINT) * {N_BINS ** i}L" for i, c in enumerate(self.columns()))))


def bins_of(data: DataFrame, task: Task) -> Bins | None:
    """None where there are no columns to bin, or too many."""
    if task.scaler == "normalizer" or len(task.features) > MOST_FEATURES:
        return None
    names = scaled_names(task)
    return Bins(names, trees.bin_edges(data, names, N_BINS))


def cell_sums(data: DataFrame, bins: Bins) -> DataFrame:
    """(_cell, n, y): rows and summed labels of the cells, by task."""
    edges = [np.array(e, float) for e in bins.edges]
    table = data.select(F.col(LABEL).cast("double").alias("_y"), *[quoted(n).cast("double").alias(f"_{i}") for i, n in enumerate(bins.names)])

    def batch_of(codes: np.ndarray, stats: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"_cell": pa.array(codes), "n": pa.array(stats[:, 0].copy()), "y": pa.array(stats[:, 1].copy())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = distinct = 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            return trees.merged(*(np.concatenate(x) for x in zip(*held)))
        for b in batches:
            if not b.num_rows:
                continue
            y, *values = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            code = np.zeros(len(y), np.int64)
            for i, (e, v) in enumerate(zip(edges, values)):
                code += np.searchsorted(e, v) * N_BINS ** i
            held.append(trees.merged(code, np.stack([np.ones(len(y)), y], 1)))
            size += len(held[-1][0])
            if size > distinct + HELD_CELLS // 4:
                held = [summed()]
                size = distinct = len(held[0][0])
                if distinct > HELD_CELLS // 4:
                    yield batch_of(*held[0])
                    held, size, distinct = [], 0, 0
        if held:
            yield batch_of(*summed())
    return table.mapInArrow(run, "_cell long, n double, y double")


def merged(data: DataFrame, bins: Bins) -> tuple[list[Transformer], DataFrame]:
    """Stages that add the bins, and a row per cell: ``_bins``, the mean label and ``_weight``, its number of rows."""
    found = checkpointed(cell_sums(data, bins).groupBy("_cell").agg((F.sum("y") / F.sum("n")).alias(LABEL), F.sum("n").alias("_weight")))
    rows = found.select(*[F.expr(f"CAST((_cell DIV {N_BINS ** i}L) % {N_BINS} AS DOUBLE)").alias(f"_bin_{i}") for i in range(len(bins.names))],
                        LABEL, "_weight")
    stages = bins.stages()
    return stages, stages[1].transform(rows)


def drawn_features(max_features: str, width: int) -> int:
    """How many features a node draws, by Spark's names and rounding."""
    share = {"all": width, "auto": width / 3, "onethird": width / 3, "sqrt": sqrt(width), "log2": max(1.0, log2(width))}.get(max_features)
    if share is None:
        share = float(max_features) if max_features.isdigit() else float(max_features) * width
    return min(width, max(1, ceil(share)))


def draws(rate: float, row: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row counts in a tree: a Poisson number with mean ``rate``."""
    most = np.cumsum([exp(-rate) * rate ** k / factorial(k) for k in range(20)])
    return np.searchsorted(most, trees.uniform(row, tree, seed, 1), "right").astype(float)


def forest(data: DataFrame, task: Task, bins: Bins, count: int, depth: int, max_features: str, rate: float,
           seed: int) -> trees.TreeStage | None:
    """A forest in which each row counts a Poisson number of times in each tree; None where there are too many cells.

    One pass sums up the cells of all trees; each tree then grows from its cells in a task.
    """
    spark, width = data.sparkSession, len(bins.names)
    table = bins.cell(data).select(F.xxhash64(quoted(task.key).cast("string")).alias("_row"), F.col(LABEL).cast("double").alias("_y"), "_cell")
    most = setting(spark, "trees.forestCells", FOREST_CELLS)
    found = table.select("_cell").distinct().limit(most + 1).collect()
    if not found or len(found) > most:
        return None
    codes = np.sort(np.array([r[0] for r in found], np.int64))
    shared = spark.sparkContext.broadcast(codes)
    spec = Spec("forest", trees=count, depth=depth, features=(drawn_features(max_features, width) + 0.5) / width, seed=seed)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = shared.value
        total = np.zeros((count, 2, len(codes)))
        for b in batches:
            row, y, cell = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            at = np.searchsorted(codes, cell)
            for t in range(count):
                weight = draws(rate, row, t, seed)
                total[t, 0] += np.bincount(at, weight, len(codes))
                total[t, 1] += np.bincount(at, weight * y, len(codes))
        for t in range(count):
            yield pa.RecordBatch.from_pydict({"tree": pa.array([t], pa.int32()), "sums": pa.array([total[t].tobytes()], pa.binary())})

    def growing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, total = shared.value, {}
        for b in batches:
            for t, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[t] = total.get(t, 0) + np.frombuffer(part).reshape(2, -1)
        bins_ = np.stack([codes // N_BINS ** i % N_BINS for i in range(width)], 1).astype(np.uint8)
        for t, (weight, label) in total.items():
            own = np.flatnonzero(weight)
            own = own if len(own) else np.arange(1)
            stats = np.stack([weight[own], label[own], np.ones(len(own))], 1)
            nodes = trees.grow(spec, bins_, N_BINS, own, np.zeros(len(own), np.int64), stats, np.array([t]))
            step = trees.slim(nodes, trees.leaf_values(spec, nodes.stats))
            yield pa.RecordBatch.from_pydict({"tree": pa.array([t], pa.int32()), "model": pa.array([zlib.compress(pickle.dumps(step), 1)], pa.binary())})
    parts = checkpointed(table.mapInArrow(sums, "tree int, sums binary").repartition("tree").mapInArrow(growing, "tree int, model binary"))
    steps = {r["tree"]: pickle.loads(zlib.decompress(r["model"])) for r in parts.toLocalIterator()}
    grown = trees.Grown([steps[t] for t in sorted(steps)], np.zeros(1))
    return trees.TreeStage(trees.TreeModel(spec, tuple(bins.names), bins.edges, grown, 0.0), "_prediction")


@dataclass(frozen=True)
class CutForest:
    """Trees over features cut at places of each tree's own; predicts the mean of the trees."""

    spec: Spec
    names: tuple[str, ...]
    cuts: list[list[tuple[int, np.ndarray]]]  # per tree: number of a feature, its places
    steps: list[tuple[trees.Nodes, np.ndarray]]
    centre: float

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """Adds the predicted number; null where a feature is null."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def guess(x: pd.Series) -> pd.Series:
            m, values = shared.value, np.stack(x.to_numpy()).astype(float)
            rows, total = np.arange(len(values)), np.zeros(len(values))
            for cut, (nodes, leaves) in zip(m.cuts, m.steps):
                total += trees.settled(nodes, leaves, cut_bins(values, cut), rows, np.zeros(len(rows), np.int64))[:, 0]
            return pd.Series(total / len(m.steps) + m.centre)
        found = F.when(none_missing(self.names), guess(F.array(*[F.coalesce(quoted(n).cast("double"), F.lit(0.0)) for n in self.names])))
        return df.withColumn(name, found)


def cut_bins(values: np.ndarray, cut: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """The number of places not above each value, a column per feature of a tree."""
    return np.stack([np.searchsorted(places, values[:, i], "right") for i, places in cut], 1).astype(np.uint8)


def cut_forest(data: DataFrame, names: Sequence[str], cuts: list[list[tuple[int, np.ndarray]]], depth: int, centre: float,
               seed: int) -> trees.TreeStage | None:
    """A tree of all rows for each of ``cuts``; None where a tree has too many cells.

    One pass sums up the rows of each tree's cells; each tree then grows from its cells in a task.
    """
    spark, n_bins = data.sparkSession, 1 + max(len(places) for cut in cuts for _, places in cut)
    if n_bins > 256 or n_bins ** max(len(cut) for cut in cuts) >= 2 ** 62:
        return None
    most = setting(spark, "trees.cutCells", CUT_CELLS)
    spec = Spec("forest", trees=len(cuts), depth=depth, seed=seed)
    table = data.select(F.col(LABEL).cast("double").alias("_y"), F.array(*[quoted(n).cast("double") for n in names]).alias("_x"))

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        return trees.merged(*(np.concatenate(x) for x in zip(*parts)))

    def batch_of(held: dict) -> pa.RecordBatch:
        found = {t: summed(parts) for t, parts in held.items()}
        return pa.RecordBatch.from_pydict({"tree": pa.array(list(found), pa.int32()), "codes": pa.array([c.tobytes() for c, _ in found.values()], pa.binary()),
                                           "sums": pa.array([s.tobytes() for _, s in found.values()], pa.binary())})

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            y = b.column(0).to_numpy(zero_copy_only=False) - centre
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            stats = np.stack([np.ones(len(y)), y], 1)
            for t, cut in enumerate(cuts):
                code = cut_bins(x, cut).astype(np.int64) @ (n_bins ** np.arange(len(cut), dtype=np.int64))
                part = trees.merged(code, stats)
                held.setdefault(t, []).append(part)
                size += len(part[0])
                if len(held[t]) > 8:
                    size -= sum(len(c) for c, _ in held[t])
                    held[t] = [summed(held[t])]
                    size += len(held[t][0][0])
            if size > HELD_CELLS:
                yield batch_of(held)
                held, size = {}, 0
        if held:
            yield batch_of(held)

    def growing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for t, codes, part in zip(*(c.to_pylist() for c in b.columns)):
                held.setdefault(t, []).append((np.frombuffer(codes, np.int64), np.frombuffer(part).reshape(-1, 2)))
                if len(held[t]) > 16:
                    held[t] = [summed(held[t])]
        for t, parts in held.items():
            codes, stats = summed(parts)
            model = None
            if len(codes) <= most:
                bins = np.stack([codes // n_bins ** j % n_bins for j in range(len(cuts[t]))], 1).astype(np.uint8)
                nodes = trees.grow(spec, bins, n_bins, np.arange(len(codes)), np.zeros(len(codes), np.int64),
                                   np.column_stack([stats, np.ones(len(codes))]), np.array([t]))
                model = zlib.compress(pickle.dumps(trees.slim(nodes, trees.leaf_values(spec, nodes.stats))), 1)
            yield pa.RecordBatch.from_pydict({"tree": pa.array([t], pa.int32()), "model": pa.array([model], pa.binary())})
    parts = checkpointed(table.mapInArrow(sums, "tree int, codes binary, sums binary").repartition("tree").mapInArrow(
        growing, "tree int, model binary"))
    steps = {r["tree"]: r["model"] for r in parts.toLocalIterator()}
    if len(steps) < len(cuts) or None in steps.values():
        return None
    grown = [pickle.loads(zlib.decompress(steps[t])) for t in range(len(cuts))]
    return trees.TreeStage(CutForest(spec, tuple(names), cuts, grown, centre), "_prediction")
