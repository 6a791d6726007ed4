"""Block pairs of the neighbour join, and what a search keeps of its neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.operators import neighbors
from tabwright.operators.models import search
from tabwright.operators.models.recipe import Task, folds, prepare


@pytest.mark.parametrize("p", [1, 2])
@pytest.mark.parametrize("shift,scale", [(0, 1), (1e6, 1), (-1e8, 1e-3), (0, 1e-9), (0, 1e200)])
def test_pairs_hold_the_nearest(monkeypatch, p, shift, scale):
    monkeypatch.setattr(neighbors, "AT_ONCE", 900)
    rng = np.random.default_rng(1)
    b = np.round(rng.normal(size=(700, 5)), 1) * scale + shift
    a = np.concatenate([b[:20], np.round(rng.normal(size=(30, 5)), 1) * scale + shift])
    with np.errstate(all="ignore"):
        row, col, d2 = neighbors._nearest_pairs(a, b, 4, p)
        whole = neighbors._distances(a, b, p)
    for i in range(len(a)):
        mine = dict(zip(col[row == i].tolist(), d2[row == i].tolist()))
        cut = np.sort(whole[i])[3]
        assert all(mine.get(j) == whole[i, j] for j in np.flatnonzero(whole[i] <= cut))


def test_a_value_that_is_no_number_costs_no_neighbours():
    b = np.arange(400.0).reshape(200, 2)
    b[::3] = np.nan
    row, col, _ = neighbors._nearest_pairs(b[1:2], b, 2, 2)
    assert {1, 2} <= set(col.tolist())


def test_query_cells_are_merged(spark):
    """In many dimensions a donor serves every cell; it travels once for a block of queries, not once for a cell."""
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(0, i, x.tolist()) for i, x in enumerate(rng.normal(size=(900, 16)))], "group int, id long, features array<double>")
    pivots = neighbors._pivot_tables(rows)
    placed = neighbors._assign(rows, pivots, 2)
    assert placed.select("cell").distinct().count() > 8
    parts = neighbors._merged_cells(placed, pivots, 400)
    used = np.unique(parts[0][parts[0] >= 0])
    assert 3 <= len(used) <= 8
    assert len(np.unique(neighbors._merged_cells(placed, pivots, 1000)[0])) <= 2


def test_trials_do_not_multiply_neighbours(spark):
    """One row per row and trial, with the guess in it: no sort or shuffle of (trial, row, neighbour)."""
    rows = spark.range(300).select("id", F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("y"))
    task = Task("id", ("a", "b"), "y")
    tuner = search.TUNERS["tune_knn_regressor"]
    drawn = search.sample_params(tuner.space, 6, 1)
    found = search.neighbour_guesses(folds(prepare(rows, task, False), task, 3), task, tuner, drawn, 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any("trial" in line for line in plan.splitlines() if "Window [" in line or "Aggregate [" in line)
    assert found.count() == 1800 and found.where(F.col("guess").isNull()).isEmpty()


def test_masked_distances_are_held_in_bounded_tables(monkeypatch):
    rng = np.random.default_rng(3)
    donors = rng.normal(size=(3_000, 3))
    queries = donors[:600].copy()
    queries[:, 0] = np.nan
    seen, product = [], np.partition
    monkeypatch.setattr(np, "partition", lambda x, *more, **named: seen.append(x.size) or product(x, *more, **named))
    whole = neighbors._masked_offers(queries, donors, [[i] for i in range(3_000)], 4)
    assert seen and max(seen) <= neighbors.MASKED_AT_ONCE
    monkeypatch.setattr(neighbors, "MASKED_AT_ONCE", 1)
    one = neighbors._masked_offers(queries, donors, [[i] for i in range(3_000)], 4)
    assert all(np.array_equal(whole[n], one[n]) for n in whole)


def test_vectors_behind_enough_nearer_copies_are_not_copied():
    """A block of many vectors of many copies each would take gigabytes otherwise."""
    rng = np.random.default_rng(2)
    a, b, copies = rng.normal(size=(50, 2)), rng.integers(-9, 9, (400, 2)) / 4.0, rng.integers(1, 22, 400)
    row, col, d2 = neighbors._nearest_pairs(a, b, 21, 2)
    kept = neighbors._needed(row, col, d2, copies, 21)
    taken = np.bincount(kept[0], copies[kept[1]], 50)
    assert copies[col].sum() > 5 * taken.sum()
    for i in range(50):
        d = ((a[i] - b) ** 2).sum(1)
        order = np.argsort(d, kind="stable")
        last = np.searchsorted(np.cumsum(copies[order]), 21)
        wanted = set(np.flatnonzero(d <= d[order[last]] * (1 + 1e-13)))
        assert set(kept[1][kept[0] == i]) == wanted


def test_many_copies_give_their_smallest_other_ids(spark):
    rows = [(0, 10 * i + c, [float(i % 40), float(i % 7)]) for i in range(60) for c in range(10)]
    points = spark.createDataFrame(rows, "group int, id long, features array<double>")
    found = {}
    for r in neighbors.knn_join(points, points, 12, exclude_self=True).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["donor_id"], round(r["distance"], 9), r["rank"]))
    x, ids = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    for i, q in enumerate(ids.tolist()):
        d = np.round(((x - x[i]) ** 2).sum(1), 9)
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:12]
        assert found[q] == [(int(ids[j]), round(float(np.sqrt(d[j])), 9), n + 1) for n, j in enumerate(order)]


def test_rows_of_an_id_share_its_neighbours(spark):
    points = spark.createDataFrame([(0, i, [float(x)]) for i, x in ((1, 0), (1, 0), (2, 1), (3, 3), (4, 7))], "group int, id long, features array<double>")
    found = neighbors.knn_join(points, points, 2, exclude_self=True).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["donor_id"], r["rank"]) for r in found] == [(1, 2, 1), (1, 2, 2), (2, 1, 1), (2, 1, 2), (3, 2, 1), (3, 1, 2), (4, 3, 1), (4, 2, 2)]
