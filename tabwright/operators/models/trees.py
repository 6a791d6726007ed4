"""Many tree ensembles grown side by side on features that are binned once.

All trees of a step grow in lockstep, level by level: the rows of a level are summed up to cells (tree, node, feature, bin),
and the cells alone decide the splits. Sums of parts of the rows add up, so the same two functions, ``cells_of`` and
``best_splits``, serve two ways of running:

* A table of at most ``tabwright.trees.localCells`` cells (rows x features, 20 million by default, a byte each) is broadcast,
  and every task grows its share of the ensembles alone.
* A larger one stays where it is. Each level is one job for all trees: tasks sum up their rows, the cells of a block of nodes
  meet in one task after a shuffle, and only splits (the model itself) come back.

Both give the same trees: whatever is drawn (rows of a tree, features of a node, random cuts) follows from hashes of the row,
the tree and the node's path.
"""

from __future__ import annotations

import pickle
import zlib
from base64 import b64decode, b64encode
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabwright.functions.columns import none_missing, quoted
from tabwright.operators.models import lines
from tabwright.operators.stats import aggregate_once, quantiles
from tabwright.session import checkpointed, setting

LOCAL_CELLS = 20_000_000
MEDIAN_CELLS = 40_000_000  # the same where medians decide the splits, which parts of the rows do not add up to
DEALT_CELLS = 200_000_000  # of a table whose drawn rows meet in a task per tree
FOREST_TASKS = 32  # that grow the trees of one forest
ROWS_AT_ONCE = 250_000  # whose cells are in memory together, or those of one node
BLOCK = 256  # nodes of a level whose cells meet in one row of the shuffle
PLACES = 9  # gains are compared to so many places, so that the order of additions does not matter
TIE = 0.5 * 10.0 ** -PLACES
CELLS_AT_ONCE = 1 << 19  # of a feature
SPARSE = 6  # keys per entry beyond which sorting is faster than counting
EXACT = 2.0 ** 26  # numbers of rows and whole weights up to this share a double
NOISE = 1e-11  # a gain below this share of the worths it is the difference of counts as none


@dataclass(frozen=True)
class Spec:
    """One ensemble. ``features``: 'all', 'sqrt', 'log2' or a share, drawn anew for each node; ``tree_features``: a share
    drawn per tree. ``rows``: 'all', 'bootstrap' (each row a Poisson number of times) or a share without repetition.

    A node of fewer than ``min_split`` rows stays a leaf, and so does one without a cut that leaves ``min_leaf`` rows on
    each side. ``impurity``: gini, entropy, variance, absolute (distances from the median, which a leaf predicts), poisson (half the
    deviance of labels of at least 0, of which ``shift`` has been taken off), or second (gradient and hessian sums with penalties
    ``l1``, ``l2``, ``gamma`` and the least hessian sum ``min_child`` of a side).
    """

    kind: str  # forest, boost, ada, stack, line (as a member)
    classes: int = 0  # 0: a number is predicted
    trees: int = 100
    depth: int = 15
    min_split: int = 2
    min_leaf: int = 1
    features: str | float = "all"
    tree_features: float = 1.0
    rows: str | float = "all"
    impurity: str = "variance"
    random_cuts: bool = False
    balanced: bool = False
    rate: float = 0.1
    l1: float = 0.0
    l2: float = 0.0
    gamma: float = 0.0
    min_child: float = 0.0
    shift: float = 0.0
    loss: str = "linear"
    members: tuple[Spec, ...] = ()  # of a stack; their outputs on rows they were not fitted on teach the final model
    final: str = "linear"  # logistic, linear, ridge, forest
    C: float = 1.0  # of a line and of a logistic final model; 1 / C is the penalty of a ridge
    inner: int = 5
    seed: int = 42

    def drawn(self, width: int) -> int:
        share = {"all": width, "sqrt": np.sqrt(width), "log2": np.log2(max(2, width))}.get(self.features)
        return max(1, int(share if share is not None else float(self.features) * width))


def hashed(*parts) -> np.ndarray:
    """64 mixed bits of whole numbers, element by element."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.asarray(p).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
    return h


def uniform(*parts) -> np.ndarray:
    return (hashed(*parts) >> np.uint64(11)).astype(np.float64) / 2.0 ** 53


# The chances of at most 0, 1, 2, ... events when one is expected.
POISSON = np.cumsum(np.exp(-1.0) / np.array([1.0, 1, 2, 6, 24, 120, 720, 5_040, 40_320, 362_880]))


def row_weights(spec: Spec, rows: np.ndarray, tree: int) -> np.ndarray:
    """How often each row counts in a tree."""
    if spec.rows == "all" or not isinstance(spec.rows, str) and spec.rows >= 1:
        return np.ones(len(rows))
    u = uniform(rows, tree, spec.seed, 1)
    return np.searchsorted(POISSON, u, "right").astype(float) if spec.rows == "bootstrap" else (u < spec.rows).astype(float)


def cells_of(bins: np.ndarray, rows: np.ndarray, place: np.ndarray, stats: np.ndarray, places: int,
             n_bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (place x features + feature) x n_bins + bin that occur, and the sums of ``stats`` (last column: rows)."""
    width, columns = bins.shape[1], stats.shape[1]
    base = place * n_bins
    alike = np.array_equal(stats[:, 0], stats[:, -1])  # rows of weight 1: their sum is their number
    if places * n_bins <= 4 * len(rows):
        sums = np.empty((places, width, n_bins, columns))
        for i in range(width):  # a feature at a time: nothing is as long as rows x features
            key = base + bins[rows, i]
            for c in range(columns - alike):
                sums[:, i, :, c] = np.bincount(key, stats[:, c], places * n_bins).reshape(places, n_bins)
        if alike:
            sums[..., -1] = sums[..., 0]
        sums = sums.reshape(-1, columns)
        keys = np.flatnonzero(sums[:, -1])
        return keys, sums[keys]
    key = ((place[:, None] * width + np.arange(width)) * n_bins + bins[rows]).ravel()
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(stats[order // width], first, 0)


def merged(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(sums[order], first, 0)


def worth(spec: Spec, stats: np.ndarray) -> np.ndarray:
    """What a node is worth; a split gains the worth of its sides less that of the node."""
    if spec.impurity == "variance":
        return stats[:, 1] ** 2 / np.maximum(stats[:, 0], 1e-300)
    if spec.impurity == "poisson":
        return _log_worth(spec, stats[:, 0], stats[:, 1])
    if spec.impurity == "second":
        g = np.sign(stats[:, 0]) * np.maximum(np.abs(stats[:, 0]) - spec.l1, 0)
        return 0.5 * g ** 2 / np.maximum(stats[:, 1] + spec.l2, 1e-300)
    weights = stats[:, :spec.classes]
    whole = weights.sum(1)
    if spec.impurity == "gini":
        return (weights ** 2).sum(1) / np.maximum(whole, 1e-300)
    return (weights * np.log(np.maximum(weights, 1e-300))).sum(1) - whole * np.log(np.maximum(whole, 1e-300))


def _log_worth(spec: Spec, weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Sums of labels times the logarithm of their mean; a side whose labels are all 0 would have an infinite deviance."""
    unit = spec.shift or 1.0  # the mean of all rows: a constant factor does not change gains
    whole = total + spec.shift * weight
    some = whole > NOISE * unit * weight
    return np.where(some, whole * np.log(np.where(some, whole, 1.0) / (unit * np.maximum(weight, 1e-300))), -1e300)


def best_splits(spec: Spec, keys: np.ndarray, sums: np.ndarray, tree: np.ndarray, path: np.ndarray, width: int,
                n_bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each place: feature (-1: none), last bin of the left side, and the sums of both sides.

    ``tree`` and ``path`` name the node at each place; every place has cells.
    """
    places = len(tree)
    group = keys // n_bins
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    length = np.diff(np.append(first, len(keys)))
    owner = np.repeat(np.arange(len(first)), length)
    running = np.cumsum(sums, 0)
    before = np.concatenate([np.zeros((1, sums.shape[1])), running])[first]
    left = running - before[owner]
    total = left[first + length - 1]
    right = total[owner] - left
    whole = worth(spec, total)[owner]
    rows = np.rint(left[:, -1]), np.rint(right[:, -1])
    valid = (rows[1] > 0) & (rows[0] >= spec.min_leaf) & (rows[1] >= spec.min_leaf) & (rows[0] + rows[1] >= spec.min_split)
    if spec.impurity == "second":
        valid &= (left[:, 1] >= spec.min_child) & (right[:, 1] >= spec.min_child)
    node, feature = np.divmod(group[first], width)
    if spec.random_cuts:  # one cut per node and feature, anywhere between its outer bins
        low, high = keys[first] % n_bins, keys[first + length - 1] % n_bins
        cut = low + (uniform(tree[node], path[node], feature, spec.seed, 2) * (high - low)).astype(np.int64)
        only = np.zeros(len(keys), bool)
        only[np.searchsorted(keys, group[first] * n_bins + cut, "right") - 1] = True
        valid &= only
    sides = worth(spec, left), worth(spec, right)
    gain = sides[0] + sides[1] - whole - spec.gamma
    valid &= gain > NOISE * (np.abs(sides[0]) + np.abs(sides[1]) + np.abs(whole))
    gain = np.where(valid, gain, 0.0)
    top = np.maximum.reduceat(gain, first)
    at = np.flatnonzero(gain >= (top * (1 - TIE))[owner])
    at = at[np.concatenate([[True], owner[at][1:] != owner[at][:-1]])]  # the first bin among equals
    best, where = np.zeros((places, width)), np.zeros((places, width), np.int64)
    best[node, feature], where[node, feature] = top, at
    if spec.tree_features < 1:
        best[~kept_features(spec, tree, width)] = 0.0
    chosen, place = None, np.arange(places)
    if spec.drawn(width) < width:
        rank = drawing(spec, tree, path, width).argsort(1)
        among = np.where(rank < spec.drawn(width), best, 0.0)
        later = np.where(best > 0, rank, width).argmin(1)  # no drawn feature splits: the next one that does
        chosen = np.where(among.max(1) > 0, largest(among), later)
    else:
        chosen = largest(best)
    at = where[place, chosen]
    return np.where(best[place, chosen] > 0, chosen, -1), keys[at] % n_bins, left[at], right[at]


def kept_features(spec: Spec, tree: np.ndarray, width: int) -> np.ndarray:
    """Whether the tree of a place may use a feature."""
    rank = uniform(tree[:, None], np.arange(width), spec.seed, 3).argsort(1).argsort(1)
    return rank < max(1, int(spec.tree_features * width))


def drawing(spec: Spec, tree: np.ndarray, path: np.ndarray, width: int) -> np.ndarray:
    """The features of each node in the order of its draw."""
    return uniform(tree[:, None], path[:, None], np.arange(width), spec.seed, 4).argsort(1)


def largest(gain: np.ndarray) -> np.ndarray:
    """The first column with the largest gain of each row, up to ``PLACES`` places."""
    most = np.maximum(gain.max(1, keepdims=True), 1e-300)
    return np.round(gain / most, PLACES).argmax(1)


@dataclass
class Nodes:
    """Trees as arrays: ``child`` is the left child, the right one follows; ``feature`` is -1 at leaves."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    stats: np.ndarray
    tree: np.ndarray
    path: np.ndarray
    frontier: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @classmethod
    def roots(cls, trees: np.ndarray, columns: int) -> Nodes:
        n = len(trees)
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, columns)), np.asarray(trees),
                   np.ones(n, np.int64), np.arange(n))

    def split(self, spec: Spec, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, right: np.ndarray, last: bool) -> None:
        """Splits the frontier's nodes and moves it to the children that may be split again."""
        done = feature >= 0
        parent = self.frontier[done]
        start = len(self.feature)
        self.feature[parent], self.cut[parent] = feature[done], cut[done]
        self.child[parent] = start + 2 * np.arange(len(parent))
        both = np.stack([left[done], right[done]], 1).reshape(-1, left.shape[1])
        n = len(both)
        self.feature = np.append(self.feature, np.full(n, -1))
        self.cut, self.child = (np.append(x, np.zeros(n, np.int64)) for x in (self.cut, self.child))
        self.stats = np.concatenate([self.stats, both])
        self.tree = np.append(self.tree, np.repeat(self.tree[parent], 2))
        self.path = np.append(self.path, (2 * self.path[parent][:, None] + np.arange(2)).ravel())
        open_ = np.rint(both[:, -1]) >= max(2, spec.min_split, 2 * spec.min_leaf)
        self.frontier = start + np.flatnonzero(open_ & (not last))

    def route(self, bins: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The leaf that each row reaches from node ``at``."""
        at = at.copy()
        moving = np.flatnonzero(self.feature[at] >= 0)
        here, own, flat = at[moving], rows[moving] * bins.shape[1], np.ascontiguousarray(bins).reshape(-1)
        while len(moving):
            here = self.child.take(here) + (flat.take(own + self.feature.take(here)) > self.cut.take(here))
            open_ = self.feature.take(here) >= 0
            at[moving] = here
            if not open_.all():
                moving, here, own = moving[open_], here[open_], own[open_]
        return at


def _by_place(place: np.ndarray, places: int) -> np.ndarray:
    """Positions sorted by place, equal ones in their order."""
    if places <= 65_536:
        return np.argsort(place.astype(np.uint16), kind="stable")  # two bytes sort fast
    return (np.sort((place.astype(np.uint64) << np.uint64(32)) | np.arange(len(place), dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)


@dataclass
class Sums:
    """What a level sums up, a number per entry: ``columns`` decide the splits (of classes: the weight of class ``kind``), ``more``
    serves leaves only. ``rows``: how many rows an entry stands for, one each if None; None as a column stands for the same numbers.
    ``packed``: whole weights, which are summed up together with the numbers of rows.
    """

    columns: list[np.ndarray | None]
    kind: np.ndarray | None = None
    more: list[np.ndarray | None] = field(default_factory=list)
    packed: bool = False
    rows: np.ndarray | None = None

    @classmethod
    def of(cls, spec: Spec, stats: np.ndarray) -> Sums:
        """From a column per sum, the last one being the numbers of rows: one each."""
        columns = list(stats[:, :-1].T)
        if spec.impurity in ("gini", "entropy"):
            return cls.weighted(spec, reduce(np.add, columns), kind=sum(i * (c > 0) for i, c in enumerate(columns)))
        if spec.impurity in ("variance", "poisson") and len(columns) == 2:
            return cls.weighted(spec, columns[0].copy(), columns[1].copy())
        columns = [None if (c == 1).all() else c.copy() for c in columns]
        return cls(columns[:2], None, columns[2:])

    @classmethod
    def weighted(cls, spec: Spec, weight: np.ndarray, total: np.ndarray | None = None, kind: np.ndarray | None = None,
                 rows: np.ndarray | None = None) -> Sums:
        """Weights and weighted labels, or weights of classes."""
        rest, each = [] if total is None else [total], 1.0 if rows is None else rows
        if (weight == each).all():
            return cls([None, *rest], kind, rows=rows)
        packed = bool(len(weight) * max(weight.max(), np.max(each)) < EXACT and (weight == np.rint(weight)).all())
        return cls([weight * EXACT + each if packed else weight, *rest], kind, packed=packed, rows=rows)

    def take(self, at: np.ndarray | slice, all_: bool = False) -> Sums:
        def part(x: np.ndarray | None) -> np.ndarray | None:
            return None if x is None else x[at] if isinstance(at, slice) else x.take(at)
        return Sums([part(c) for c in self.columns], part(self.kind), [part(c) for c in self.more] if all_ else [], self.packed, part(self.rows))

    def stats(self, place: np.ndarray, places: int, classes: int) -> np.ndarray:
        """places x sums: those of splits, those of leaves, numbers of rows."""
        n, columns = self.at_nodes(place, places, classes)
        return np.stack([*columns, *[n if c is None else np.bincount(place, c, places) for c in self.more], n], 1)

    def split_up(self, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of rows and weights that were summed up together."""
        weight = np.floor(both * (1 / EXACT))
        return both - weight * EXACT, weight

    def cells(self, key: np.ndarray, size: int, classes: int, counted: bool = True) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """The keys that occur, their numbers of rows (if ``counted``), and their sums (a column per class, or one of each)."""
        first = self.rows if self.columns[0] is None else self.columns[0]
        if size > SPARSE * len(key) and classes <= 2:
            return self._few_cells(key, classes)
        if self.kind is None:
            found = np.bincount(key, first if self.packed else self.rows, size)
            at = np.flatnonzero(found)
            n, columns = found[at], []
            if self.packed:
                n, weight = self.split_up(n)
                columns.append(weight)
            for c in self.columns[self.packed:]:
                columns.append(n.astype(float) if c is None else np.bincount(key, c, size)[at])
            return at, n, columns
        table = np.bincount(key * classes + self.kind, first, size * classes).reshape(size, classes).T
        if self.columns[0] is None or self.packed:
            at = np.flatnonzero(reduce(np.add, table))
            columns = [c[at] for c in table]
            if self.packed:
                parts, columns = zip(*[self.split_up(c) for c in columns])
                return at, reduce(np.add, parts), list(columns)
            return at, reduce(np.add, columns), [c.astype(float) for c in columns]
        n = np.bincount(key, self.rows, size) if counted else reduce(np.add, table)
        at = np.flatnonzero(n)
        return at, n[at], [c[at] for c in table]

    def _few_cells(self, key: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """``cells`` by sorting, where few of the keys occur."""
        both = np.sort(key.astype(np.uint64) << np.uint64(32) | np.arange(len(key), dtype=np.uint64))
        order, key = (both & np.uint64(0xFFFFFFFF)).astype(np.int64), (both >> np.uint64(32)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])

        def summed(c: np.ndarray) -> np.ndarray:
            return np.add.reduceat(c.take(order), first)
        n = np.diff(np.append(first, len(key))).astype(float) if self.rows is None else summed(self.rows)
        weight = n if self.columns[0] is None else None
        if self.packed:
            n, weight = self.split_up(summed(self.columns[0]))
        if self.kind is None:
            return key[first], n, [*([weight] if weight is not None else []), *[n if c is None else summed(c) for c in self.columns[weight is not None:]]]
        each = self.columns[0] if self.columns[0] is not None else np.ones(len(key)) if self.rows is None else self.rows
        parts = [summed(np.where(self.kind == c, each, 0.0)) for c in range(classes)]
        return key[first], n, [self.split_up(c)[1] for c in parts] if self.packed else parts

    def at_nodes(self, place: np.ndarray, places: int, classes: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The same for each place, also where nothing is."""
        at, n, columns = self.cells(place, places, classes)
        if len(at) == places:
            return n, columns
        out = [np.zeros(places) for _ in range(1 + len(columns))]
        for o, c in zip(out, [n, *columns]):
            o[at] = c
        return out[0], out[1:]


def _worths(spec: Spec, columns: list[np.ndarray]) -> np.ndarray:
    """``worth`` of sums held by column."""
    if spec.impurity == "variance":
        return columns[1] * columns[1] / np.maximum(columns[0], 1e-300)
    if spec.impurity == "poisson":
        return _log_worth(spec, columns[0], columns[1])
    if spec.impurity == "second":
        g = np.maximum(np.abs(columns[0]) - spec.l1, 0)
        return 0.5 * g * g / np.maximum(columns[1] + spec.l2, 1e-300)
    whole = reduce(np.add, columns)
    if spec.impurity == "gini":
        return reduce(np.add, [c * c for c in columns]) / np.maximum(whole, 1e-300)
    return reduce(np.add, [c * np.log(np.maximum(c, 1e-300)) for c in columns]) - whole * np.log(np.maximum(whole, 1e-300))


def _gains(spec: Spec, left: list[np.ndarray], right: list[np.ndarray], whole: np.ndarray) -> np.ndarray:
    """What splits gain, 0 where that is no more than rounding."""
    a, b = _worths(spec, left), _worths(spec, right)
    gain = a + b - whole - spec.gamma
    return np.where(gain > NOISE * (np.abs(a) + np.abs(b) + np.abs(whole)), gain, 0.0)


def _best_cut(spec: Spec, bin_: np.ndarray, sums: Sums, place: np.ndarray, places: int, n_bins: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest gain of each place by one feature (0: none), and the last bin of its left side; ``place``: times ``n_bins``."""
    at, n, columns = sums.cells(place + bin_, places * n_bins, spec.classes, spec.min_leaf > 1)
    owner = at // n_bins
    first = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1])
    length = np.diff(np.append(first, len(at)))
    last = first + length - 1

    def sides(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        run = np.cumsum(c)
        return run - np.repeat(run[first] - c[first], length), np.repeat(run[last], length) - run
    left, right = zip(*[sides(c) for c in columns])
    value = _worths(spec, left) + _worths(spec, right)
    if spec.min_leaf > 1:
        rows = sides(n)
        value[np.minimum(*rows) < spec.min_leaf] = -np.inf
    if spec.impurity == "second" and spec.min_child > 0:
        value[np.minimum(left[1], right[1]) < spec.min_child] = -np.inf
    value[last] = -np.inf
    whole = _worths(spec, [c[last] for c in left])
    top = np.maximum.reduceat(value, first)
    some = np.isfinite(top)
    slack = np.where(some, TIE * np.maximum(top - whole - spec.gamma, 0), 0.0)
    equal = np.flatnonzero(value >= np.repeat(top - slack, length))
    best = equal[np.searchsorted(equal, first)]  # the first bin among equals
    gain = _gains(spec, [c[best] for c in left], [c[best] for c in right], whole)
    return np.where(some, gain, 0.0), at[best] - owner[best] * n_bins


def _random_cut(spec: Spec, bin_: np.ndarray, sums: Sums, place: np.ndarray, size: np.ndarray, tree: np.ndarray, path: np.ndarray,
                feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for one cut per place, anywhere between its outer bins."""
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    low, high = (f.reduceat(bin_, start).astype(np.int64) for f in (np.minimum, np.maximum))
    cut = low + (uniform(tree, path, feature, spec.seed, 2) * (high - low)).astype(np.int64)
    below = bin_ <= np.repeat(cut.astype(np.uint8), size)
    n, both = sums.at_nodes(2 * place + below, 2 * len(size), spec.classes)
    right, left = ([c[i::2] for c in both] for i in (0, 1))
    valid = (n[1::2] >= spec.min_leaf) & (n[::2] >= max(1, spec.min_leaf)) & (low < high)
    if spec.impurity == "second":
        valid &= np.minimum(left[1], right[1]) >= spec.min_child
    gain = np.where(valid, _gains(spec, left, right, _worths(spec, [a + b for a, b in zip(left, right)])), 0.0)
    return gain, np.maximum.reduceat(np.where(below, bin_, 0), start).astype(np.int64)


def whole_steps(values: np.ndarray) -> tuple[np.ndarray, float]:
    """Values as whole multiples of a power of two, whose sums are exact: 62 bits hold the sum of all. Also that power."""
    most = max(float(np.abs(values).max(initial=0.0)), 1e-290) * max(1, len(values))
    unit = 2.0 ** (np.ceil(np.log2(most)) - 61)
    return np.rint(values / unit).astype(np.int64), unit


def _median_stats(y: np.ndarray, unit: float, place: np.ndarray, places: int) -> np.ndarray:
    """places x (entries, their number times their median, entries) of entries sorted by value at each place."""
    size = np.bincount(place, minlength=places)
    own = y[_by_place(place, places)] * unit
    start = np.cumsum(size) - size
    last = max(0, len(own) - 1)
    middle = (own[np.minimum(start + np.maximum(size - 1, 0) // 2, last)] + own[np.minimum(start + size // 2, last)]) / 2
    return np.stack([size, size * np.where(size > 0, middle, 0.0), size], 1).astype(float)


def _spreads(rank: np.ndarray, y: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Sums of the distances from the median of each stretch [low, high) of ``y``, in whole numbers.

    ``rank`` orders the values of a stretch. The stretches go down a wavelet matrix of the ranks, all at once.
    """
    run = np.concatenate([[0], np.cumsum(y)])
    size = high - low
    whole, left, below = run[high] - run[low], size // 2, np.zeros(len(low), np.int64)
    for bit in range(int(rank.max(initial=0)).bit_length() - 1, -1, -1):
        upper = (rank >> bit & 1).astype(bool)
        zero = np.concatenate([[0], np.cumsum(~upper)])
        total = np.concatenate([[0], np.cumsum(np.where(upper, 0, y))])
        first, last = zero[low], zero[high]
        up = left >= last - first
        below += np.where(up, total[high] - total[low], 0)
        left = left - np.where(up, last - first, 0)
        low, high = np.where(up, zero[-1] + low - first, first), np.where(up, zero[-1] + high - last, last)
        order = np.concatenate([np.flatnonzero(~upper), np.flatnonzero(upper)])
        rank, y = rank[order], y[order]
    return whole - 2 * below - np.where(size % 2 == 1, y[low], 0)


def _median_cut(spec: Spec, bin_: np.ndarray, y: np.ndarray, place: np.ndarray, size: np.ndarray, n_bins: int) -> tuple[np.ndarray, np.ndarray]:
    """``_best_cut`` by distances from the median; the entries of a place are sorted by value."""
    start = np.cumsum(size) - size
    rank = (np.arange(len(y)) - np.repeat(start, size)).astype(np.int32)
    key = place + bin_
    order = _by_place(key, len(size) * n_bins)
    key, rank, y = key[order], rank[order], y[order]
    whole = _spreads(rank, y, start, start + size)
    end = np.flatnonzero(key[1:] != key[:-1]) + 1  # of a cell
    at = key[end - 1] // n_bins
    low, high = start[at], start[at] + size[at]
    kept = (np.minimum(end - low, high - end) >= max(1, spec.min_leaf)) & (whole[at] > 0) & (size[at] >= spec.min_split)
    end, at, low, high = end[kept], at[kept], low[kept], high[kept]
    gain, cut = np.zeros(len(size)), np.zeros(len(size), np.int64)
    if len(at):
        sides = _spreads(rank, y, np.append(low, end), np.append(end, high))
        gains = (whole[at] - sides[:len(at)] - sides[len(at):]).astype(float)
        first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        top = np.maximum.reduceat(gains, first)
        equal = np.flatnonzero(gains >= np.repeat(top, np.diff(np.append(first, len(at)))))
        best = equal[np.searchsorted(equal, first)]  # the first bin among equals
        gain[at[first]], cut[at[first]] = top, key[end[best] - 1] % n_bins
    return gain, cut


def _node_splits(spec: Spec, bins: np.ndarray, sums: Sums, size: np.ndarray, tree: np.ndarray, path: np.ndarray, width: int,
                 n_bins: int, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature (-1: none) and cut of each place; its entries follow each other, ``size`` of them, ``held`` rows.

    Only features that a node may use are summed up: the drawn ones, then one after the other where none of these splits.
    """
    places, drawn = len(size), spec.drawn(width)
    unit = 1 if spec.random_cuts else n_bins
    place = np.repeat(np.arange(0, places * unit, unit), size)
    base, flat = np.arange(0, bins.size, bins.shape[1]), bins.reshape(-1)
    feature, cut = np.full(places, -1), np.zeros(places, np.int64)
    kept = kept_features(spec, tree, width) if spec.tree_features < 1 else None

    def tried(feature: np.ndarray, at: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Gain and cut of a feature per place, of the places ``at`` or all."""
        names, numbers, part, sizes = (tree, path), place, sums, size
        if at is not None:
            names, sizes = (tree[at], path[at]), size[at]
            chosen = np.zeros(places, bool)
            chosen[at] = True
            rows = np.flatnonzero(np.repeat(chosen, size))
            numbers, part = np.repeat(np.arange(0, len(at) * unit, unit), sizes), sums.take(rows)
            values = flat.take(base[rows] + np.repeat(feature, sizes))
        elif (feature == feature[0]).all():
            values = bins[:, feature[0]]
        else:
            values = flat.take(base + np.repeat(feature, sizes))
        if spec.random_cuts:
            gain, at_bin = _random_cut(spec, values, part, numbers, sizes, *names, feature)
        elif spec.impurity == "absolute":
            gain, at_bin = _median_cut(spec, values, part.columns[1], numbers, sizes, n_bins)
        else:
            gain, at_bin = _best_cut(spec, values, part, numbers, len(sizes), n_bins)
        gain[(held if at is None else held[at]) < spec.min_split] = 0.0
        if kept is not None:
            used = kept if at is None else kept[at]
            gain[~used[np.arange(len(sizes)), feature]] = 0.0
        return gain, at_bin

    if drawn == width:
        used = [f for f in range(width) if kept is None or kept[:, f].any()]
        order = np.tile(np.array(used), (places, 1))
        among = len(used)
    else:
        order = drawing(spec, tree, path, width)
        order[:, :drawn].sort(1)  # among equals, the first feature
        among = drawn
    gains, cuts = (np.stack(x, 1) for x in zip(*[tried(order[:, j], None) for j in range(among)]))
    best = largest(gains)
    row = np.arange(places)
    found = gains[row, best] > 0
    feature[found], cut[found] = order[row, best][found], cuts[row, best][found]
    for j in range(among, order.shape[1]):
        none = np.flatnonzero((feature < 0) & (held >= spec.min_split))
        if not len(none):
            break
        gain, at_bin = tried(order[none, j], none)
        feature[none[gain > 0]], cut[none[gain > 0]] = order[none, j][gain > 0], at_bin[gain > 0]
    return feature, cut


def _cell_splits(spec: Spec, bins: np.ndarray, sums: Sums, size: np.ndarray, tree: np.ndarray, path: np.ndarray, width: int,
                 n_bins: int, held: np.ndarray) -> tuple[np.ndarray, ...]:
    """``best_splits`` of the cells: reweighted numbers follow its rounding, which many rounds of weights would magnify."""
    place, keys, values = np.repeat(np.arange(0, len(size) * n_bins, n_bins), size), [], []
    for f in range(width):
        at, n, columns = sums.cells(place + bins[:, f], len(size) * n_bins, 0)
        keys.append((at // n_bins * width + f) * n_bins + at % n_bins)
        values.append(np.stack([*columns, n], 1))
    keys, values = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(keys)
    return best_splits(spec, keys[order], values[order], tree, path, width, n_bins)


def words_of(bins: np.ndarray) -> np.ndarray:
    """The bins of a row in whole words, which are moved faster."""
    own = np.zeros((len(bins), -(-bins.shape[1] // 8) * 8), np.uint8)
    own[:, :bins.shape[1]] = bins
    return own.view(np.uint64)


def _taken(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    return words[:, 0].take(at)[:, None] if words.shape[1] == 1 else words.take(at, 0)


def grow(spec: Spec, bins: np.ndarray, n_bins: int, rows: np.ndarray, tree: np.ndarray, stats: np.ndarray | Sums,
         names: np.ndarray, leaf: np.ndarray | None = None, words: np.ndarray | None = None) -> Nodes:
    """Trees of entries (row, tree, stats): ``tree`` is a position in ``names``; every tree has entries, which stand for one row
    each or for several in the same bins.

    Entries lie sorted by node. Sums are taken by counting, some nodes at a time, whose cells fit into little room. ``leaf``
    receives the leaf of each entry; ``words`` are those of ``bins``.
    """
    sums, width = stats if isinstance(stats, Sums) else Sums.of(spec, stats), bins.shape[1]
    absolute = spec.impurity == "absolute"
    if absolute:
        if spec.random_cuts or sums.columns[0] is not None:
            raise ValueError("distances from the median: for searched cuts and rows of weight 1 only")
        y, unit = whole_steps(sums.columns[1])
        sums, order = Sums([None, y]), np.lexsort((y, tree))
        whole = _median_stats(y[order], unit, tree[order], len(names))
    else:
        whole = sums.stats(tree, len(names), spec.classes)
    nodes = Nodes.roots(names, whole.shape[1])
    nodes.stats = whole
    words = words_of(bins[rows]) if words is None else _taken(words, rows)
    if leaf is not None:
        leaf[:], entry = tree, np.arange(len(rows))
    by_cells = spec.kind == "ada" and not spec.classes
    place = tree
    if not absolute:
        order = None if (place[1:] >= place[:-1]).all() else _by_place(place, len(names))
    for level in range(spec.depth):
        places = len(nodes.frontier)
        if not places:
            break
        size = np.bincount(place, minlength=places)
        if order is not None:
            place, sums, words = np.repeat(np.arange(places), size), sums.take(order, True), _taken(words, order)
            entry = None if leaf is None else entry.take(order)
        own = words.view(np.uint8)
        ends = np.concatenate([[0], np.cumsum(size)])
        found, low = [], 0
        while low < places:
            high = max(low + 1, min(int(np.searchsorted(ends, ends[low] + ROWS_AT_ONCE, "right")) - 1, low + CELLS_AT_ONCE // n_bins))
            part, at = slice(ends[low], ends[high]), nodes.frontier[low:high]
            choose = _cell_splits if by_cells else _node_splits
            found.append(choose(spec, own[part], sums.take(part), size[low:high], nodes.tree[at], nodes.path[at], width, n_bins,
                                np.rint(nodes.stats[at, -1])))
            low = high
        feature, cut, *sides = (np.concatenate(x) for x in zip(*found))
        values = own.reshape(-1).take(np.arange(0, own.size, own.shape[1]) + np.repeat(np.maximum(feature, 0), size))
        side = 2 * place + (values > np.repeat(cut, size))
        if by_cells:
            both = np.stack(sides, 1)
        else:
            both = _median_stats(sums.columns[1], unit, side, 2 * places) if absolute else sums.stats(side, 2 * places, spec.classes)
            both = both.reshape(places, 2, -1)
        split = feature >= 0
        children = np.where(split, len(nodes.feature) + 2 * (np.cumsum(split) - 1), -1)
        parents = nodes.frontier
        nodes.split(spec, feature, cut, both[:, 0], both[:, 1], last=level + 1 == spec.depth)
        at = np.where(split[:, None], children[:, None] + np.arange(2), parents[:, None]).ravel()  # the node of each side
        following = np.full(len(nodes.feature), -1)
        following[nodes.frontier] = np.arange(len(nodes.frontier))
        place = following[at][side]
        open_ = place >= 0
        if open_.all():
            order = _by_place(place, len(nodes.frontier))
            continue
        if leaf is not None:
            gone = np.flatnonzero(~open_)
            leaf[entry[gone]] = at[side[gone]]
        kept = np.flatnonzero(open_)
        place = place[kept]
        order = kept[_by_place(place, len(nodes.frontier))]
    return nodes


@dataclass(frozen=True)
class Data:
    """A binned table in memory: bins, number of bins, label (class number or value), hash of the key, fold."""

    bins: np.ndarray
    n_bins: int
    label: np.ndarray
    row: np.ndarray
    fold: np.ndarray
    raw: np.ndarray | None = None  # the features themselves, where a stack has a line

    @cached_property
    def words(self) -> np.ndarray:
        return words_of(self.bins)

    @cached_property
    def kinds(self) -> tuple[np.ndarray, np.ndarray]:
        """For each row the number of its combination of bins, and one row of each combination: a tree can't tell its rows apart."""
        keys = list(self.words.T)
        order = np.lexsort(keys) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
        differ = reduce(np.logical_or, [k[order][1:] != k[order][:-1] for k in keys], np.zeros(max(0, len(order) - 1), bool))
        number = np.empty(len(order), np.int32)
        number[order] = np.concatenate([[0], np.cumsum(differ)])[:len(order)]
        return number, order[np.concatenate([[0], np.flatnonzero(differ) + 1])] if len(order) else order

    def distinct(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One row of each combination of bins among ``rows``, and which of them each row is like."""
        number, one = self.kinds
        found = np.bincount(number[rows], minlength=len(one)) > 0
        return one[found], (np.cumsum(found) - 1)[number[rows]]


def class_weights(spec: Spec, counts: np.ndarray) -> np.ndarray:
    """Weight of each class: n / (classes x size), classes that do not occur left out."""
    if not spec.balanced or not spec.classes:
        return np.ones(max(1, spec.classes))
    return counts.sum() / (np.count_nonzero(counts) * np.maximum(counts, 1))


def forest_stats(spec: Spec, label: np.ndarray, weight: np.ndarray, by_class: np.ndarray) -> np.ndarray:
    if spec.classes:
        kind = label.astype(int)
        return np.concatenate([np.eye(spec.classes)[kind] * (weight * by_class[kind])[:, None], np.ones((len(label), 1))], 1)
    return np.stack([weight, weight * label, np.ones(len(label))], 1)


def forest_sums(spec: Spec, label: np.ndarray, weight: np.ndarray, by_class: np.ndarray) -> Sums:
    """The same for growing in memory."""
    if spec.classes:
        kind = label.astype(int)
        return Sums.weighted(spec, weight * by_class[kind] if (by_class != 1).any() else weight, kind=kind)
    return Sums.weighted(spec, weight, weight * label)


def leaf_values(spec: Spec, stats: np.ndarray) -> np.ndarray:
    """Class shares, means, or steps (columns of one or more numbers) of nodes."""
    if spec.kind == "boost":
        if spec.impurity == "second":
            g = np.sign(stats[:, 0]) * np.maximum(np.abs(stats[:, 0]) - spec.l1, 0)
            return (-g / np.maximum(stats[:, 1] + spec.l2, 1e-12))[:, None]
        k = max(2, spec.classes)
        step = stats[:, 1] / np.maximum(stats[:, 2], 1e-12)
        return (step * ((k - 1) / k if spec.classes > 2 else 1.0))[:, None]
    if spec.classes:
        shares = stats[:, :spec.classes]
        return shares / np.maximum(shares.sum(1, keepdims=True), 1e-300)
    return (stats[:, 1] / np.maximum(stats[:, 0], 1e-300))[:, None]


def start_margin(spec: Spec, counts: np.ndarray, mean: float) -> np.ndarray:
    """The constant that boosting starts from, one number per output; ``counts``: rows of each class."""
    if not spec.classes:
        return np.array([mean])
    share = np.clip(counts / max(1, counts.sum()), 1e-15, 1 - 1e-15)
    return np.array([np.log(share[1] / share[0])]) if spec.classes == 2 else np.log(share)


def boost_stats(spec: Spec, label: np.ndarray, margin: np.ndarray, output: int, weight: np.ndarray) -> np.ndarray:
    """Gradient sums of one output; the subsample's weight is 0 or 1."""
    one = np.ones(len(label))
    if not spec.classes:
        rest, h = label - margin[:, 0], one
    elif spec.classes == 2:
        p = 1 / (1 + np.exp(-margin[:, 0]))
        rest, h = label - p, p * (1 - p)
    else:
        e = np.exp(margin - margin.max(1, keepdims=True))
        p = e[:, output] / e.sum(1)
        rest = (label == output) - p
        h = np.abs(rest) * (1 - np.abs(rest)) if spec.impurity != "second" else 2 * p * (1 - p)
    if spec.impurity == "second":
        return np.stack([-rest, h, one], 1) * weight[:, None]
    return np.stack([one, rest, h, one], 1) * weight[:, None]


def boost_sums(spec: Spec, found: np.ndarray, count: np.ndarray, margin: np.ndarray) -> Sums:
    """The same of all outputs, one after the other, for ``count`` rows of one margin each; ``found``: their sums of labels (of two
    classes, too) or their numbers of each class."""
    k = margin.shape[1]
    if not spec.classes:
        rest, h = found[:, 0] - count * margin[:, 0], count
    elif spec.classes == 2:
        p = 1 / (1 + np.exp(-margin[:, 0]))
        rest, h = found[:, 0] - count * p, count * (p * (1 - p))
    else:
        most = reduce(np.maximum, margin.T)
        e = [np.exp(m - most) for m in margin.T]
        whole = reduce(np.add, e)
        p = np.concatenate([x / whole for x in e])
        count = np.tile(count, k)
        rest = found.T.ravel() - count * p
        h = count * (p * (1 - p)) * (2 if spec.impurity == "second" else 1)
    rows = None if (count == 1).all() else count
    if spec.impurity == "second":
        return Sums([-rest, None if h is count else h], rows=rows)
    return Sums([None, rest], more=[None if h is count else h], rows=rows)


def outputs(spec: Spec) -> int:
    """Scores per row; boosting of two classes has a single margin."""
    return spec.classes if spec.classes > 2 or spec.kind != "boost" and spec.classes else 1


def slim(nodes: Nodes, values: np.ndarray) -> tuple[Nodes, np.ndarray]:
    """What scoring needs, in little room: a leaf's ``child`` is the place of its value, and ``path`` counts the trees only."""
    leaf = nodes.feature < 0
    child = np.where(leaf, np.cumsum(leaf) - 1, nodes.child).astype(np.int32)
    none, ones = np.zeros(0, np.int64), np.ones(int((nodes.path == 1).sum()), np.int8)
    return Nodes(nodes.feature.astype(np.int16), nodes.cut.astype(np.uint8), child, np.zeros((0, 0)), none, ones), values[leaf]


@dataclass
class Grown:
    """The trees of a fit: ``steps`` of ``slim`` trees and values, and what combines them."""

    steps: list[tuple[Nodes, np.ndarray]]
    start: np.ndarray
    trust: list[float] = field(default_factory=list)  # of reweighted trees


def settled(nodes: Nodes, values: np.ndarray, bins: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The values that rows reach from node ``at`` of ``slim`` trees."""
    return values[nodes.child[nodes.route(bins, rows, at)]]


def fit_trees(spec: Spec, data: Data, train: np.ndarray) -> Grown:
    if not len(train):
        return Grown([], np.zeros(outputs(spec)))
    return {"forest": _forest, "boost": _boost, "ada": _ada}[spec.kind](spec, data, train)


def fit_predict(spec: Spec, data: Data, train: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Fits on rows ``train`` and gives the outputs (class scores, or one number) of rows ``rest``."""
    if spec.kind == "stack":
        return _stacked(spec, data, train, rest)
    rest, like = data.distinct(rest)
    return _fit_scores(spec, data, train, rest)[like]


def _fit_scores(spec: Spec, data: Data, train: np.ndarray, rest: np.ndarray) -> np.ndarray:
    if spec.kind == "forest" and len(train):  # scored as it grows: all trees of a deep forest together take much room
        out = np.zeros((len(rest), outputs(spec)))
        for step in _forest_steps(spec, data, train, 0, spec.trees):
            out += _votes(*step, data.bins, rest)
        return out / spec.trees
    return scores(spec, fit_trees(spec, data, train), data.bins, rest)


def _together(rows: int, width: int) -> int:
    """Trees of a forest that grow at once."""
    return max(1, 400_000 // max(1, rows * width))


def _forest_steps(spec: Spec, data: Data, train: np.ndarray, first: int, last: int) -> Iterator[tuple[Nodes, np.ndarray]]:
    """Trees ``first`` to ``last`` - 1, some at a time."""
    by_class = class_weights(spec, np.bincount(data.label[train].astype(int), minlength=spec.classes) if spec.classes else None)
    together = _together(len(train), data.bins.shape[1])
    one, like = data.distinct(train)
    label = data.label[train]
    size = len(one) * max(1, spec.classes)
    like = like * spec.classes + label.astype(int) if spec.classes else like  # rows of the same bins, and of the same class, are one
    for start in range(first, last, together):
        entries = []
        for t in range(start, min(last, start + together)):
            weight = row_weights(spec, data.row[train], t)
            weight = weight if weight.any() else np.ones(len(train))
            if spec.impurity == "absolute":  # its labels do not add up
                kept = np.flatnonzero(weight)
                entries.append((train[kept], np.full(len(kept), t - start), weight[kept], weight[kept] * label[kept], np.ones(len(kept))))
                continue
            whole = np.bincount(like, weight, size)
            kept = np.flatnonzero(whole)
            count = whole if spec.rows != "bootstrap" else np.bincount(like, weight > 0, size)
            total = whole if spec.classes else np.bincount(like, weight * label, size)
            entries.append((kept, np.full(len(kept), t - start), whole[kept], total[kept], count[kept]))
        at, tree, weight, total, count = (np.concatenate(x) for x in zip(*entries))
        if spec.classes:
            kind, rows = at % spec.classes, one[at // spec.classes]
            sums = Sums.weighted(spec, weight * by_class[kind] if (by_class != 1).any() else weight, kind=kind, rows=count)
        else:
            rows = at if spec.impurity == "absolute" else one[at]
            sums = Sums.weighted(spec, weight, total, rows=None if spec.impurity == "absolute" else count)
        nodes = grow(spec, data.bins, data.n_bins, rows, tree, sums, np.arange(start, start + len(entries)), words=data.words)
        yield slim(nodes, leaf_values(spec, nodes.stats))


def _forest(spec: Spec, data: Data, train: np.ndarray) -> Grown:
    return Grown(list(_forest_steps(spec, data, train, 0, spec.trees)), np.zeros(outputs(spec)))


def _votes(nodes: Nodes, values: np.ndarray, bins: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the trees' values for each of ``rows``."""
    n = len(nodes.path)
    return settled(nodes, values, bins, np.tile(rows, n), np.repeat(np.arange(n), len(rows))).reshape(n, len(rows), -1).sum(0)


def _boost(spec: Spec, data: Data, train: np.ndarray) -> Grown:
    k, label = outputs(spec), data.label[train]
    counts = np.bincount(label.astype(int), minlength=spec.classes) if spec.classes else None
    grown = Grown([], start_margin(spec, counts, label.mean()))
    one, like = data.distinct(train)  # rows of the same bins keep the same margin
    margin = np.tile(grown.start, (len(one), 1))
    for t in range(spec.trees):
        weight = row_weights(spec, data.row[train], t)
        if not weight.any():
            continue
        count = np.bincount(like, weight, len(one))
        kept, rest = np.flatnonzero(count), np.flatnonzero(count == 0)
        if k > 1:
            found = np.bincount(like * k + label.astype(int), weight, k * len(one)).reshape(-1, k)[kept]
        else:
            found = np.bincount(like, weight * label, len(one))[kept][:, None]
        stats = boost_sums(spec, found, count[kept], margin[kept])
        leaf = np.zeros(k * len(kept), np.int64)
        nodes = grow(spec, data.bins, data.n_bins, np.tile(one[kept], k), np.repeat(np.arange(k), len(kept)), stats,
                     np.arange(k) + t * k, leaf, data.words)
        values = leaf_values(spec, nodes.stats)
        for c in range(k):
            margin[kept, c] += spec.rate * values[leaf[c * len(kept):(c + 1) * len(kept)], 0]
            margin[rest, c] += spec.rate * values[nodes.route(data.bins, one[rest], np.full(len(rest), c)), 0]
        grown.steps.append(slim(nodes, values))
    return grown


def alike(data: Data, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One of the rows of the same bins and label each, and how many these are."""
    keys = [*data.words[rows].T, data.label[rows]]
    order = np.lexsort(keys)
    differ = reduce(np.logical_or, [k[order][1:] != k[order][:-1] for k in keys], np.zeros(max(0, len(rows) - 1), bool))
    first = np.concatenate([[0], np.flatnonzero(differ) + 1])
    return rows[order[first]], np.diff(np.append(first, len(rows)))


def _ada(spec: Spec, data: Data, train: np.ndarray) -> Grown:
    """Reweighting: SAMME for classes (votes), R2 for numbers (weighted median over the trees)."""
    weight = np.full(len(train), 1 / len(train))
    if spec.classes and spec.min_leaf <= 1 and spec.min_split <= 2:
        train, size = alike(data, train)  # rows of the same bins and class keep the same weight
        weight = weight[0] * size
    label, grown = data.label[train], Grown([], np.zeros(outputs(spec)))
    for t in range(spec.trees):
        stats = forest_sums(spec, label, weight, np.ones(max(1, spec.classes)))
        leaf = np.zeros(len(train), np.int64)
        nodes = grow(spec, data.bins, data.n_bins, train, np.zeros(len(train), np.int64), stats, np.array([t]), leaf, data.words)
        values = leaf_values(spec, nodes.stats)
        values = values.argmax(1).astype(float)[:, None] if spec.classes else values
        own = values[leaf, 0]
        if spec.classes:
            loss = (own != label).astype(float)
            error = (weight * loss).sum() / weight.sum()
            hopeless = error >= 1 - 1 / spec.classes
        else:
            away = np.abs(own - label)
            worst = away.max()
            share = away / worst if worst > 0 else away
            loss = {"linear": share, "square": share ** 2, "exponential": 1 - np.exp(-share)}[spec.loss]
            error = (weight * loss).sum() / weight.sum() if worst > 0 else 0.0
            hopeless = error >= 0.5
        if hopeless and t:
            break
        grown.steps.append(slim(nodes, values))
        if hopeless or error <= 0:
            grown.trust.append(1.0 if not grown.trust else 10 * max(grown.trust))
            break
        odds = np.log((1 - error) / error)
        grown.trust.append(spec.rate * (odds + (np.log(spec.classes - 1) if spec.classes else 0.0)))
        weight = weight * np.exp(grown.trust[-1] * (loss if spec.classes else loss - 1)) / weight.sum()
    return grown


def member_outputs(spec: Spec, data: Data, train: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """What a stack's final model sees of a member: its number, or the chances of all classes but the first."""
    if spec.kind == "line":
        job, w = lines.fit_in_memory(lines.Line(spec.classes, spec.C, max_iter=500), data.raw[train], data.label[train])
        out = job.features(data.raw[rest]) @ w
    else:
        out = fit_predict(spec, data, train, rest)
    if not spec.classes:
        return out
    if spec.kind in ("line", "boost"):
        out = np.column_stack([np.zeros(len(out)), out]) if out.shape[1] == 1 else out
        out = np.exp(out - out.max(1, keepdims=True))
    return (out / np.maximum(out.sum(1, keepdims=True), 1e-300))[:, 1:]


def _stacked(spec: Spec, data: Data, train: np.ndarray, rest: np.ndarray) -> np.ndarray:
    if not len(train) or not len(rest):
        return np.zeros((len(rest), max(1, spec.classes)))
    members = [replace(m, classes=spec.classes, seed=spec.seed) for m in spec.members]
    part = (hashed(data.row[train], spec.seed, 5) % np.uint64(spec.inner)).astype(int)
    seen = np.zeros((len(train), len(members) * max(1, spec.classes - 1)))
    for f in np.unique(part):
        own = part == f
        seen[own] = np.column_stack([member_outputs(m, data, train[~own], train[own]) for m in members])
    new = np.column_stack([member_outputs(m, data, train, rest) for m in members])
    label = data.label[train]
    if spec.final == "logistic":
        job, w = lines.fit_in_memory(lines.Line(spec.classes, spec.C, max_iter=500), seen, label)
        out = job.features(new) @ w
        return np.column_stack([np.zeros(len(out)), out]) if out.shape[1] == 1 else out
    if spec.final == "forest":
        edges = [np.unique(np.quantile(c, np.arange(1, 64) / 64)) for c in seen.T]
        both = np.concatenate([seen, new])
        bins = np.stack([np.searchsorted(e, both[:, i], "left") for i, e in enumerate(edges)], 1).astype(np.uint8)
        inside = Data(bins, 64, np.append(label, np.zeros(len(new))), np.append(data.row[train], data.row[rest]), np.zeros(len(both)))
        top = Spec("forest", spec.classes, 100, 30, features="sqrt" if spec.classes else "all", rows="bootstrap",
                   impurity="gini" if spec.classes else "variance", seed=spec.seed)
        return fit_predict(top, inside, np.arange(len(train)), len(train) + np.arange(len(rest)))
    centre, level = seen.mean(0), label.mean()
    gram = (seen - centre).T @ (seen - centre) + np.eye(seen.shape[1]) * (1 / spec.C if spec.final == "ridge" else 1e-9)
    return ((new - centre) @ np.linalg.solve(gram, (seen - centre).T @ (label - level)) + level)[:, None]


def scores(spec: Spec, grown: Grown, bins: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Class scores, or one number, for each of ``rows``."""
    out = np.tile(grown.start, (len(rows), 1))
    if not grown.steps or not len(rows):
        return out
    if spec.kind == "forest":
        for nodes, values in grown.steps:
            out += _votes(nodes, values, bins, rows)
        return out / spec.trees
    if spec.kind == "boost":
        for nodes, values in grown.steps:
            for c in range(out.shape[1]):
                out[:, c] += spec.rate * settled(nodes, values, bins, rows, np.full(len(rows), c))[:, 0]
        return out
    guesses = np.array([settled(nodes, values, bins, rows, np.zeros(len(rows), np.int64))[:, 0] for nodes, values in grown.steps])
    trust = np.array(grown.trust)
    if spec.classes:
        for guess, vote in zip(guesses, trust):
            out[np.arange(len(rows)), guess.astype(int)] += vote
        return out
    order = np.argsort(guesses, 0, kind="stable")
    reached = np.cumsum(trust[order], 0) >= 0.5 * trust.sum()
    return np.take_along_axis(guesses, np.take_along_axis(order, reached.argmax(0)[None], 0), 0)[0][:, None]


def second_score(spec: Spec, out: np.ndarray) -> np.ndarray | None:
    """Of two classes, how far the second is ahead; None for other tasks."""
    if spec.classes != 2:
        return None
    return out[:, 0] if out.shape[1] == 1 else out[:, 1] - out[:, 0]


def predictions(spec: Spec, out: np.ndarray) -> np.ndarray:
    """Class numbers (the smallest among equal scores) or values."""
    if not spec.classes:
        return out[:, 0]
    if out.shape[1] == 1:
        return (out[:, 0] > 0).astype(float)
    return np.round(out, 12).argmax(1).astype(float)


# --- tables ------------------------------------------------------------------------------------------------------------


def bin_edges(rows: DataFrame, features: Sequence[str], n_bins: int = 64) -> list[list[float]]:
    """Upper ends of the bins but the last, per feature: quantiles of equal shares."""
    found = quantiles(rows, list(features), [i / n_bins for i in range(1, n_bins)])
    return [sorted(set(found[f] or [])) for f in features]


def binned(rows: DataFrame, key: str, features: Sequence[str], label: str, edges: list[list[float]], raw: bool = False) -> DataFrame:
    """(_row: hash of the key, _fold, _y, _bins: a byte per feature); a value lies in the bin of the first edge not below it.

    With ``raw``, the features follow in the same column.
    """
    table = rows.select(F.xxhash64(quoted(key).cast("string")).alias("_row"), F.col("_fold"), quoted(label).cast("double").alias("_y"),
                        F.array(*[quoted(f).cast("double") for f in features]).alias("_x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(edges))
            bins = np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)], 1).astype(np.uint8)
            data = pa.array([r.tobytes() + (v.tobytes() if raw else b"") for r, v in zip(bins, x)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), data], names=["_row", "_fold", "_y", "_bins"])
    return table.mapInArrow(run, "_row long, _fold int, _y double, _bins binary")


def _arrays(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    row, fold, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
    return np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(batch.num_rows, -1), y, row, fold


PREDICTED = "fit int, _row long, _y double, _p double, _s double"


def _predicted(fit: int, spec: Spec, row: np.ndarray, label: np.ndarray, out: np.ndarray) -> pa.RecordBatch:
    score = second_score(spec, out)
    score = pa.nulls(len(row), pa.float64()) if score is None else pa.array(score, pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(row), fit, np.int32)), pa.array(row), pa.array(label),
                                       pa.array(predictions(spec, out)), score], names=["fit", "_row", "_y", "_p", "_s"])


def fits_in_tasks(spark: SparkSession, rows: int, width: int, fits: Sequence[tuple[Spec, int]]) -> bool:
    bytes_each = width * (9 if any(m.kind == "line" for spec, _ in fits for m in spec.members) else 1)
    return rows * bytes_each <= setting(spark, "trees.localCells", LOCAL_CELLS)


def out_of_fold(table: DataFrame, width: int, fits: Sequence[tuple[Spec, int]], n_bins: int = 64) -> DataFrame:
    """(fit, _row, _y, _p, _s): for each (ensemble, fold), predictions of the fold's rows by an ensemble of all other rows.

    ``table`` comes from ``binned``. A fold of -1 predicts all rows by an ensemble of all rows. Classes are predicted by
    number; ``_s`` is the second class's lead where there are two. Rows of equal key are drawn alike. Poisson fits predict
    nothing where a label is negative or all are 0: their deviance does not exist.
    """
    table = checkpointed(table)
    found = aggregate_once(table, {"n": F.count(F.lit(1)), "m": F.avg("_y"), "least": F.min("_y")})
    centre = 0.0 if any(s.classes for s, _ in fits) else found["m"] or 0.0  # sums of centred labels lose no digits
    centred, fits = table.withColumn("_y", F.col("_y") - centre), [(replace(s, shift=centre) if s.impurity == "poisson" else s, f) for s, f in fits]
    able = [i for i, (s, _) in enumerate(fits) if s.impurity != "poisson" or not found["n"] or found["least"] >= 0 < centre]
    medians = {i for i in able if fits[i][0].impurity == "absolute"}

    def grown(run: Callable[..., DataFrame], own: list[int]) -> DataFrame:
        out = run(centred, width, [fits[i] for i in own], n_bins)
        return out if len(own) == len(fits) else out.withColumn("fit", F.get(F.array(*[F.lit(i) for i in own]), F.col("fit")))
    if fits_in_tasks(table.sparkSession, found["n"], width, fits):
        parts = [(_in_tasks, able)]
    else:
        if medians:
            check_medians(table.sparkSession, found["n"] * width)
        parts = [(_in_tasks, sorted(medians)), (_by_levels, [i for i in able if i not in medians])]
    made = [grown(run, own) for run, own in parts if own]
    out = reduce(DataFrame.unionByName, made) if made else table.sparkSession.createDataFrame([], PREDICTED)
    return out.withColumns({"_y": F.col("_y") + centre, "_p": F.col("_p") + centre})


def check_medians(spark: SparkSession, cells: int) -> None:
    most = setting(spark, "trees.medianCells", MEDIAN_CELLS)
    if cells > most:
        raise ValueError(f"distances from the median: {cells} values, more than the {most} of tabwright.trees.medianCells that a task may hold")


def _collected(table: DataFrame, width: int, n_bins: int) -> Data | None:
    """The table in memory; its size has been checked."""
    parts = [_arrays(b, width) for b in table.toArrow().combine_chunks().to_batches()]
    if not parts:
        return None
    bins, label, row, fold = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((label, row))  # whatever order the rows came in
    raw = bins[order, width:].copy().view(np.float64) if bins.shape[1] > width else None
    return Data(np.ascontiguousarray(bins[order, :width]), n_bins, label[order], row[order], fold[order], raw)


def _in_tasks(table: DataFrame, width: int, fits: Sequence[tuple[Spec, int]], n_bins: int) -> DataFrame:
    spark = table.sparkSession
    data = _collected(table, width, n_bins)
    if data is None:
        return spark.createDataFrame([], PREDICTED)
    # the dearest fits first, and each a task of its own
    cost = sorted(range(len(fits)), key=lambda i: -sum(m.trees * m.depth for m in fits[i][0].members or [fits[i][0]]))
    shared = spark.sparkContext.broadcast((data, list(fits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, jobs = shared.value
        for batch in batches:
            for i in [cost[j] for j in batch.column(0).to_pylist()]:
                spec, held = jobs[i]
                rest = np.flatnonzero((data.fold == held) | (held < 0))
                out = fit_predict(spec, data, np.flatnonzero((data.fold != held) | (held < 0)), rest)
                yield _predicted(i, spec, data.row[rest], data.label[rest], out)
    return spark.range(0, len(fits), 1, len(fits)).mapInArrow(run, PREDICTED)


@dataclass(frozen=True)
class TreeModel:
    """A fitted ensemble: a few arrays, which travel with the scoring tasks."""

    spec: Spec
    features: tuple[str, ...]
    edges: list[list[float]]
    grown: Grown
    centre: float
    labels: tuple[str, ...] = ()

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """Adds the predicted class or number; null where a feature is null."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def guess(x: pd.Series) -> pd.Series:
            m = shared.value
            values = np.stack(x.to_numpy()).astype(float)
            bins = np.stack([np.searchsorted(e, values[:, i], "left") for i, e in enumerate(m.edges)], 1).astype(np.uint8)
            found = predictions(m.spec, scores(m.spec, m.grown, bins, np.arange(len(bins)))) + m.centre
            return pd.Series(found)
        whole = none_missing(self.features)
        found = F.when(whole, guess(F.array(*[F.coalesce(quoted(f).cast("double"), F.lit(0.0)) for f in self.features])))
        if self.labels:
            found = F.get(F.array(*[F.lit(x) for x in self.labels]), found.cast("int"))
        return df.withColumn(name, found)


class TreeStage(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted ensemble as a stage of a pipeline; it is saved with the pipeline as text."""

    ensemble = Param(Params._dummy(), "ensemble", "the fitted arrays", typeConverter=TypeConverters.toString)
    output = Param(Params._dummy(), "output", "name of the predicted column", typeConverter=TypeConverters.toString)

    def __init__(self, model: TreeModel | None = None, output: str = "prediction"):
        super().__init__()
        self._model = model
        if model is not None:
            self._set(output=output)

    def write(self):
        if self._model is not None:  # as text only for saving
            saved = TreeStage()
            saved._resetUid(self.uid)
            saved._set(ensemble=b64encode(pickle.dumps(self._model)).decode(), output=self.getOrDefault(self.output))
            return saved.write()
        return super().write()

    def _transform(self, df: DataFrame) -> DataFrame:
        if self._model is None:
            self._model = pickle.loads(b64decode(self.getOrDefault(self.ensemble)))
        return self._model.transform(df, self.getOrDefault(self.output))


def _grown_in_tasks(spark: SparkSession, data: Data | None, spec: Spec) -> Grown:
    """The ensemble of all rows: a forest's trees in several tasks, other ensembles in one; parts come back one by one."""
    if data is None:
        return Grown([], np.zeros(outputs(spec)))
    every, step = np.arange(len(data.label)), max(1, spec.trees)
    if spec.kind == "forest":
        together = _together(len(every), data.bins.shape[1])
        step = -(-spec.trees // (FOREST_TASKS * together)) * together
    starts = range(0, max(1, spec.trees), step)
    shared = spark.sparkContext.broadcast((data, spec))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, own = shared.value
        for batch in batches:
            for i in batch.column(0).to_pylist():
                if own.kind == "forest":
                    part = list(_forest_steps(own, data, every, starts[i], min(own.trees, starts[i] + step)))
                else:
                    part = fit_trees(own, data, every)
                yield pa.RecordBatch.from_pydict({"part": pa.array([i], pa.int64()), "model": pa.array([zlib.compress(pickle.dumps(part), 1)], pa.binary())})
    found = checkpointed(spark.range(0, len(starts), 1, len(starts)).mapInArrow(run, "part long, model binary"))
    parts = {r["part"]: pickle.loads(zlib.decompress(r["model"])) for r in found.toLocalIterator()}
    if spec.kind != "forest":
        return parts[0]
    return Grown([step for i in sorted(parts) for step in parts[i]], np.zeros(outputs(spec)))


def fit_model(rows: DataFrame, key: str, features: Sequence[str], label: str, spec: Spec, labels: Sequence[str] = (),
              n_bins: int = 64) -> TreeModel:
    """One ensemble of all rows; ``label`` holds class numbers (of ``labels``) or values."""
    edges = bin_edges(rows, features, n_bins)
    table = checkpointed(binned(rows.withColumn("_fold", F.lit(0)), key, features, label, edges))
    found = aggregate_once(table, {"n": F.count(F.lit(1)), "m": F.avg("_y")})
    centre = 0.0 if spec.classes else found["m"] or 0.0
    table, width = table.withColumn("_y", F.col("_y") - centre), len(features)
    spec = replace(spec, shift=centre) if spec.impurity == "poisson" else spec
    local = found["n"] * width <= setting(rows.sparkSession, "trees.localCells", LOCAL_CELLS)
    if spec.impurity == "absolute" and not local:
        check_medians(rows.sparkSession, found["n"] * width)
    if local or spec.impurity == "absolute":
        grown = _grown_in_tasks(rows.sparkSession, _collected(table, width, n_bins), spec)
    else:
        kept: list[Grown] = []
        _by_levels(table, width, [(spec, -1)], n_bins, kept)
        grown = kept[0]
    return TreeModel(spec, tuple(features), edges, grown, centre, tuple(labels))


def fit_dealt(rows: DataFrame, key: str, features: Sequence[str], label: str, spec: Spec, n_bins: int = 32) -> TreeModel | None:
    """A forest of classes (numbers in ``label``) whose trees grow in a task each, from the rows that the tree draws.

    Nothing but counts and the trees passes the driver. None beyond ``tabwright.trees.dealtCells`` values.
    """
    width, spark = len(features), rows.sparkSession
    if aggregate_once(rows, {"n": F.count(F.lit(1))})["n"] * width > setting(spark, "trees.dealtCells", DEALT_CELLS):
        return None
    edges = bin_edges(rows, features, n_bins)
    table = checkpointed(binned(rows.withColumn("_fold", F.lit(0)), key, features, label, edges))
    counts = np.zeros(spec.classes)
    for r in table.groupBy("_y").agg(F.count("*").alias("n")).collect():  # classes
        counts[int(r["_y"])] = r["n"]
    by_class = class_weights(spec, counts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins, y, row, _ = _arrays(b, width)
            for t in range(spec.trees):
                weight = row_weights(spec, row, t)
                own = np.flatnonzero(weight)
                if len(own):
                    data = np.column_stack([y[own], weight[own]]).tobytes()
                    yield pa.RecordBatch.from_pydict({"tree": pa.array([t], pa.int32()), "bins": pa.array([bins[own].tobytes()], pa.binary()),
                                                      "rest": pa.array([data], pa.binary())})

    def growing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in batches:
            for t, bins, rest in zip(*(c.to_pylist() for c in b.columns)):
                held.setdefault(t, []).append((np.frombuffer(bins, np.uint8).reshape(-1, width), np.frombuffer(rest).reshape(-1, 2)))
        for t in list(held):
            bins, rest = (np.concatenate(x) for x in zip(*held.pop(t)))
            sums = forest_sums(spec, rest[:, 0], rest[:, 1].copy(), by_class)
            nodes = grow(spec, bins, n_bins, np.arange(len(bins)), np.zeros(len(bins), np.int64), sums, np.array([t]))
            step = slim(nodes, leaf_values(spec, nodes.stats))
            yield pa.RecordBatch.from_pydict({"tree": pa.array([t], pa.int32()), "model": pa.array([zlib.compress(pickle.dumps(step), 1)], pa.binary())})
    dealt = table.mapInArrow(deal, "tree int, bins binary, rest binary").repartition(4 * spec.trees, "tree")  # few share a task
    found = checkpointed(dealt.mapInArrow(growing, "tree int, model binary"))
    steps = {r["tree"]: pickle.loads(zlib.decompress(r["model"])) for r in found.coalesce(8).toLocalIterator()}  # a job per part
    if not steps:
        return None
    kept = [steps[t] for t in sorted(steps)]
    return TreeModel(replace(spec, trees=len(kept)), tuple(features), edges, Grown(kept, np.zeros(outputs(spec))), 0.0)


# --- large tables: a job per level -------------------------------------------------------------------------------------


def _by_levels(table: DataFrame, width: int, fits: Sequence[tuple[Spec, int]], n_bins: int,
               kept: list[Grown] | None = None) -> DataFrame:
    """Forests and boosting; all fits grow in lockstep, a round of boosting after the other. The trees go to ``kept``."""
    if not all(spec.kind in ("forest", "boost") for spec, _ in fits):
        raise ValueError("reweighted and stacked ensembles of large tables: use the fits in boost and stack")
    spark, fits = table.sparkSession, list(fits)
    sizes = {(r["_fold"], r["_y"]): r["n"] for r in table.groupBy("_fold", "_y").agg(F.count("*").alias("n")).collect()} if any(
        s.classes for s, _ in fits) else {}
    sums = {r["_fold"]: (r["n"], r["s"]) for r in table.groupBy("_fold").agg(F.count("*").alias("n"), F.sum("_y").alias("s")).collect()}
    weights, starts = [], []
    for spec, held in fits:
        if spec.classes:
            count = np.zeros(spec.classes)
            for (fold, y), n in sizes.items():
                count[int(y)] += n * (fold != held or held < 0)
            weights.append(class_weights(spec, count))
            starts.append(start_margin(spec, count, 0.0) if spec.kind == "boost" else np.zeros(spec.classes))
        else:
            n, s = (sum(v[i] for f, v in sums.items() if f != held or held < 0) for i in (0, 1))
            weights.append(np.ones(1))
            starts.append(start_margin(spec, None, s / n if n and spec.kind == "boost" else 0.0))
    outs = [outputs(s) for s, _ in fits]
    offset = np.concatenate([[0], np.cumsum(outs)]).astype(int)
    state = table.withColumn("_state", F.lit(b"").cast("binary"))
    rounds = max(s.trees if s.kind == "boost" else 1 for s, _ in fits)
    for t in range(rounds):
        grown = []
        for i, (spec, _) in enumerate(fits):
            if spec.kind == "boost":
                names = np.arange(outs[i]) + t * outs[i] if t < spec.trees else np.zeros(0, np.int64)
            else:
                names = np.arange(spec.trees) if t == 0 else np.zeros(0, np.int64)
            columns = (spec.classes + 1 if spec.classes else 3) if spec.kind != "boost" else 3 if spec.impurity == "second" else 4
            grown.append(Nodes.roots(names, columns))
        for level in range(max(s.depth for s, _ in fits)):
            for i, (spec, _) in enumerate(fits):
                if level >= spec.depth:
                    grown[i].frontier = grown[i].frontier[:0]
            if any(len(g.frontier) for g in grown):
                _level(state, width, n_bins, fits, weights, starts, offset, grown, level)
        if kept is not None:
            kept[:] = kept or [Grown([], s) for s in starts]
            for (spec, _), held, nodes in zip(fits, kept, grown):
                if len(nodes.feature):
                    held.steps.append(slim(nodes, leaf_values(spec, nodes.stats)))
        state = checkpointed(state.mapInArrow(
            _stepper(spark.sparkContext.broadcast(grown), width, fits, starts, offset), state.schema))
    return state.mapInArrow(_reader(fits, starts, offset), PREDICTED)


def _margins(raw: list[bytes], starts: list[np.ndarray]) -> np.ndarray:
    """rows x outputs of all fits; an empty state is the starting constants."""
    if raw and not raw[0]:
        return np.tile(np.concatenate(starts), (len(raw), 1))
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1).copy()


def _entries(spec: Spec, names: np.ndarray, kept: np.ndarray, y: np.ndarray, row: np.ndarray, margin: np.ndarray,
             by_class: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position of the tree, rows, stats) of the training rows ``kept``."""
    for position, name in enumerate(names.tolist()):
        draw = name // k if spec.kind == "boost" else name
        weight = row_weights(spec, row[kept], draw)
        own = np.flatnonzero(weight)
        if spec.kind == "boost":
            stats = boost_stats(spec, y[kept[own]], margin[kept[own]], name % k, weight[own])
        else:
            stats = forest_stats(spec, y[kept[own]], weight[own], by_class)
        yield position, kept[own], stats


def _level(state: DataFrame, width: int, n_bins: int, fits, weights, starts, offset, grown: list[Nodes], level: int) -> None:
    """One more level of all trees."""
    spark = state.sparkSession
    shared = spark.sparkContext.broadcast(grown)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            bins, y, row, fold = _arrays(batch, width)
            margin = _margins(batch.column(4).to_pylist(), starts)
            for i, (spec, out) in enumerate(fits):
                nodes = shared.value[i]
                if not len(nodes.frontier):
                    continue
                place = np.full(len(nodes.feature), -1)
                place[nodes.frontier] = np.arange(len(nodes.frontier))
                kept = np.flatnonzero((fold != out) | (out < 0))
                roots = np.flatnonzero(nodes.path == 1)
                for position, rows, stats in _entries(spec, nodes.tree[roots], kept, y, row,
                                                      margin[:, offset[i]:offset[i + 1]], weights[i], offset[i + 1] - offset[i]):
                    at = place[nodes.route(bins, rows, np.full(len(rows), roots[position]))]
                    own = at >= 0
                    if own.any():
                        low = int(at[own].min()) // BLOCK * BLOCK  # a tree's nodes lie close together
                        keys, cells = cells_of(bins, rows[own], at[own] - low, stats[own], int(at[own].max()) - low + 1, n_bins)
                        keys = keys + low * width * n_bins
                        blocks = keys // (BLOCK * width * n_bins)
                        for b in np.unique(blocks).tolist():
                            held.setdefault((i, b), []).append((keys[blocks == b], cells[blocks == b]))
            for name, parts in held.items():
                held[name] = [merged(*(np.concatenate(x) for x in zip(*parts)))]
        for (i, b), ((keys, cells),) in held.items():
            yield pa.RecordBatch.from_pydict({"fit": pa.array([i], pa.int32()), "block": pa.array([b], pa.int32()),
                                              "keys": [keys.astype(np.int64).tobytes()], "sums": [cells.tobytes()]})

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for i, b, keys, cells in zip(*(c.to_pylist() for c in batch.columns)):
                keys = np.frombuffer(keys, np.int64)
                held.setdefault((i, b), []).append((keys, np.frombuffer(cells).reshape(len(keys), -1)))
                if len(held[i, b]) > 8:
                    held[i, b] = [merged(*(np.concatenate(x) for x in zip(*held[i, b])))]
        for (i, b), parts in held.items():
            keys, cells = merged(*(np.concatenate(x) for x in zip(*parts)))
            nodes = shared.value[i]
            places = np.unique(keys // (width * n_bins))
            dense = np.searchsorted(places, keys // (width * n_bins))
            keys = dense * width * n_bins + keys % (width * n_bins)
            own = nodes.frontier[places]
            feature, cut, left, right = best_splits(fits[i][0], keys, cells, nodes.tree[own], nodes.path[own], width, n_bins)
            yield pa.RecordBatch.from_pydict({
                "fit": pa.array(np.full(len(places), i, np.int32)), "place": pa.array(places.astype(np.int64)),
                "feature": pa.array(feature.astype(np.int32)), "cut": pa.array(cut.astype(np.int32)),
                "left": [x.tobytes() for x in left], "right": [x.tobytes() for x in right]})
    cells = state.mapInArrow(sums, "fit int, block int, keys binary, sums binary").repartition("fit", "block")
    found = cells.mapInArrow(choose, "fit int, place long, feature int, cut int, left binary, right binary").collect()
    for i, (spec, _) in enumerate(fits):
        mine = sorted((r for r in found if r["fit"] == i), key=lambda r: r["place"])
        if not len(grown[i].frontier):
            continue
        places = np.array([r["place"] for r in mine], np.int64)
        grown[i].frontier = grown[i].frontier[places]
        left, right = (np.array([np.frombuffer(r[s]) for r in mine]).reshape(len(mine), grown[i].stats.shape[1]) for s in ("left", "right"))
        feature, cut = (np.array([r[c] for r in mine], np.int64) for c in ("feature", "cut"))
        if not level:
            grown[i].stats[grown[i].frontier] = left + right
        grown[i].split(spec, feature, cut, left, right, last=level + 1 == spec.depth)
    shared.destroy()


def _stepper(shared, width: int, fits, starts, offset) -> Callable:
    """Adds the round's trees to the state."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = _arrays(batch, width)[0]
            margin, every = _margins(batch.column(4).to_pylist(), starts), np.arange(batch.num_rows)
            for i, (spec, _) in enumerate(fits):
                nodes, k = shared.value[i], offset[i + 1] - offset[i]
                if not len(nodes.feature):
                    continue
                values = leaf_values(spec, nodes.stats)
                roots = np.flatnonzero(nodes.path == 1)
                if spec.kind == "boost":
                    for c, root in enumerate(roots.tolist()):
                        margin[:, offset[i] + c] += spec.rate * values[nodes.route(bins, every, np.full(len(every), root)), 0]
                else:
                    total = np.zeros((len(every), k))
                    for root in roots.tolist():
                        total += values[nodes.route(bins, every, np.full(len(every), root))]
                    margin[:, offset[i]:offset[i + 1]] = total / len(roots)
            data = pa.array([r.tobytes() for r in margin], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], data], names=batch.schema.names)
    return run


def _reader(fits, starts, offset) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, fold, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            margin = _margins(batch.column(4).to_pylist(), starts)
            for i, (spec, held) in enumerate(fits):
                own = np.flatnonzero((fold == held) | (held < 0))
                yield _predicted(i, spec, row[own], y[own], margin[own, offset[i]:offset[i + 1]])
    return run
