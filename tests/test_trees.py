"""Ensembles grown in lockstep against a grower that looks at every cut of every node."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.operators.models import trees
from tabwright.operators.models.trees import Data, Spec, fit_predict, grow, leaf_values, uniform


def some_data(n=240, classes=0, seed=0, bins=16):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, bins, (n, 4)).astype(np.uint8)
    y = np.sin(x[:, 0] / 3) + 0.2 * x[:, 1] * (x[:, 2] > 7) + 0.3 * rng.normal(size=n)
    if classes:
        y = np.digitize(y, np.quantile(y, np.arange(1, classes) / classes)).astype(float)
    return Data(x, bins, y, rng.integers(0, 2 ** 62, n), np.arange(n) % 5)


def brute_worth(spec, s):
    if spec.impurity == "variance":
        return s[1] ** 2 / s[0]
    if spec.impurity == "second":
        return 0.5 * np.sign(s[0]) ** 2 * max(0, abs(s[0]) - spec.l1) ** 2 / (s[1] + spec.l2)
    w = s[:spec.classes]
    if spec.impurity == "gini":
        return (w ** 2).sum() / w.sum()
    return sum(a * np.log(a / w.sum()) for a in w if a > 0)


def brute_leaves(spec, bins, stats, rows, tree=0, path=1, depth=0):
    """{leaf path: rows}, by trying every feature and cut."""
    s = stats[rows].sum(0)
    best = None
    width = bins.shape[1]
    allowed = range(width)
    rank = np.argsort(np.argsort(uniform(tree, path, np.arange(width), spec.seed, 4)))
    gains = {}
    if depth < spec.depth and len(rows) >= spec.min_split:
        for f in allowed:
            values = sorted(set(bins[rows, f]))
            cuts = values[:-1]
            if spec.random_cuts and cuts:
                u = uniform(tree, path, f, spec.seed, 2)
                c = values[0] + int(u * (int(values[-1]) - int(values[0])))
                cuts = [max(v for v in values if v <= c)]
            for c in cuts:
                left, right = rows[bins[rows, f] <= c], rows[bins[rows, f] > c]
                a, b = stats[left].sum(0), stats[right].sum(0)
                if min(len(left), len(right)) < spec.min_leaf or spec.impurity == "second" and min(a[1], b[1]) < spec.min_child:
                    continue
                gain = brute_worth(spec, a) + brute_worth(spec, b) - brute_worth(spec, s) - spec.gamma
                if gain > 1e-9 and gain > gains.get(f, (0, 0))[0] + 1e-9:
                    gains[f] = gain, c
    drawn = [f for f in gains if rank[f] < spec.drawn(width)] or ([min(gains, key=lambda f: rank[f])] if gains else [])
    for f in sorted(drawn):
        if best is None or gains[f][0] > best[0] + 1e-9:
            best = *gains[f], f
    if best is None:
        return {path: rows}
    _, c, f = best
    left, right = rows[bins[rows, f] <= c], rows[bins[rows, f] > c]
    return {**brute_leaves(spec, bins, stats, left, tree, 2 * path, depth + 1),
            **brute_leaves(spec, bins, stats, right, tree, 2 * path + 1, depth + 1)}


@pytest.mark.parametrize("spec", [
    Spec("forest", depth=6), Spec("forest", depth=30, min_split=9), Spec("forest", depth=9, min_leaf=7), Spec("forest", 3, depth=7, impurity="gini"),
    Spec("forest", 2, depth=5, impurity="entropy", min_split=20, min_leaf=3), Spec("forest", depth=8, features="sqrt"),
    Spec("forest", depth=6, random_cuts=True, features=0.5), Spec("boost", depth=6, impurity="second", l2=1.5, l1=0.4, gamma=0.3, min_child=5)])
def test_trees_equal_brute_force(spec):
    data = some_data(classes=spec.classes)
    one = np.ones(len(data.label))
    if spec.impurity == "second":
        stats = np.stack([-data.label, one, one], 1)
    else:
        stats = trees.forest_stats(spec, data.label, one, np.ones(max(1, spec.classes)))
    names = np.array([0, 5, 6])  # three trees in lockstep
    rows = np.tile(np.arange(len(one)), 3)
    nodes = grow(spec, data.bins, data.n_bins, rows, np.repeat(np.arange(3), len(one)), np.tile(stats, (3, 1)), names)
    for position, name in enumerate(names):
        leaf = nodes.route(data.bins, np.arange(len(one)), np.full(len(one), position))
        got = {int(nodes.path[i]): np.flatnonzero(leaf == i).tolist() for i in np.unique(leaf)}
        want = brute_leaves(spec, data.bins, stats, np.arange(len(one)), name)
        assert got == {p: r.tolist() for p, r in want.items()}
        assert len(got) > 4


def test_random_cuts_differ_between_nodes():
    data = some_data(2_000, bins=60)
    spec = Spec("forest", depth=6, random_cuts=True)
    stats = trees.forest_stats(spec, data.label, np.ones(2_000), np.ones(1))
    nodes = grow(spec, data.bins, 60, np.arange(2_000), np.zeros(2_000, np.int64), stats, np.array([0]))
    used = list(zip(nodes.feature[nodes.feature >= 0], nodes.cut[nodes.feature >= 0]))
    assert len(set(used)) > 0.7 * len(used) and len({f for f, _ in used}) == 4


def test_second_order_boosting_equals_a_small_booster():
    data = some_data(150)
    spec = Spec("boost", trees=6, depth=3, rate=0.3, impurity="second", l1=0.1, l2=2.0, gamma=0.05, min_child=4)
    train, rest = np.flatnonzero(data.fold), np.flatnonzero(data.fold == 0)
    margin = np.full(150, data.label[train].mean())
    one = np.ones(150)
    for t in range(6):
        stats = np.stack([margin - data.label, one, one], 1)
        for path, rows in brute_leaves(spec, data.bins, stats, train, t).items():
            g = stats[rows, 0].sum()
            step = -np.sign(g) * max(0, abs(g) - 0.1) / (len(rows) + 2.0)
            inside = np.ones(150, bool)
            margin_rows = rows_of_leaf(spec, data, stats, train, t, path)
            margin[margin_rows] += 0.3 * step
    assert np.allclose(fit_predict(spec, data, train, rest)[:, 0], margin[rest])


def rows_of_leaf(spec, data, stats, train, tree, leaf):
    """All rows that reach a leaf of the tree grown on the training rows."""
    def go(rows, every, path, depth):
        inside = brute_leaves(spec, data.bins, stats, rows, tree, path, depth)
        if list(inside) == [path]:
            return {path: every}
        left = np.concatenate([r for p, r in inside.items() if bin(p)[2:].startswith(bin(2 * path)[2:])])
        right = np.setdiff1d(rows, left)
        f, c = next((f, c) for f in range(4) for c in range(16) if len(left) and (data.bins[left, f] <= c).all()
                    and (data.bins[right, f] > c).all() and same_split(spec, data, stats, rows, f, c))
        return {**go(left, every[data.bins[every, f] <= c], 2 * path, depth + 1),
                **go(right, every[data.bins[every, f] > c], 2 * path + 1, depth + 1)}
    return go(train, np.arange(len(data.label)), 1, 0)[leaf]


def same_split(spec, data, stats, rows, feature, cut):
    """The first feature and cut with the largest gain."""
    best = (0.0, None)
    for f in range(4):
        for c in sorted(set(data.bins[rows, f]))[:-1]:
            left, right = rows[data.bins[rows, f] <= c], rows[data.bins[rows, f] > c]
            if min(len(left), len(right)) < spec.min_child:
                continue
            gain = sum(brute_worth(spec, stats[r].sum(0)) for r in (left, right)) - brute_worth(spec, stats[rows].sum(0))
            if gain > best[0] + 1e-9:
                best = gain, (f, c)
    return best[1] == (feature, cut)


def table_of(spark, data, parts):
    rows = [(int(r), int(f), float(y), b.tobytes()) for r, f, y, b in zip(data.row, data.fold, data.label, data.bins)]
    return spark.createDataFrame(rows, "_row long, _fold int, _y double, _bins binary").repartition(parts)


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_a_job_per_level_gives_the_same_predictions(spark, classes):
    data = some_data(300, classes)
    impurity = "gini" if classes else "variance"
    fits = [(Spec("forest", classes, trees=5, depth=7, features="sqrt", rows="bootstrap", impurity=impurity, balanced=classes == 2), 0),
            (Spec("forest", classes, trees=3, depth=4, min_leaf=5, impurity=impurity), 1),
            (Spec("forest", classes, trees=2, depth=6, random_cuts=True, impurity=impurity), 2),
            (Spec("boost", classes, trees=4, depth=3, rows=0.7), 3),
            (Spec("boost", classes, trees=3, depth=2, impurity="second", l2=1.0, tree_features=0.5), -1)]

    def found():
        rounded = {c: F.round(c, 9) for c in ("_y", "_p", "_s")}
        return sorted(map(tuple, trees.out_of_fold(table_of(spark, data, 3), 4, fits, 16).withColumns(rounded).collect()), key=str)
    alone = found()
    spark.conf.set("tabwright.trees.localCells", "0")
    try:
        levels = found()
    finally:
        spark.conf.unset("tabwright.trees.localCells")
    assert levels == alone and len(alone) == 4 * 60 + 300


def test_reweighting_learns_and_constant_labels_pass():
    data = some_data(300, 2)
    train, rest = np.flatnonzero(data.fold), np.flatnonzero(data.fold == 0)
    got = trees.predictions(spec := Spec("ada", 2, trees=30, depth=1, rate=1.0, impurity="gini"), fit_predict(spec, data, train, rest))
    assert (got == data.label[rest]).mean() > 0.75
    number = some_data(300)
    out = fit_predict(Spec("ada", trees=30, depth=3, rate=1.0), number, train, rest)[:, 0]
    assert np.corrcoef(out, number.label[rest])[0, 1] > 0.8
    flat = Data(data.bins, 16, np.ones(300), data.row, data.fold)
    for kind in ("forest", "boost", "ada"):
        assert np.allclose(fit_predict(Spec(kind, trees=3), flat, train, rest), 1.0)
        assert fit_predict(Spec(kind, trees=3), flat, train[:0], rest).shape == (60, 1)


@pytest.mark.parametrize("classes,final", [(0, "linear"), (0, "ridge"), (0, "forest"), (2, "logistic"), (3, "forest"), (3, "logistic")])
def test_stacks_see_outputs_of_rows_not_fitted_on(classes, final):
    data = some_data(300, classes)
    data = Data(data.bins, 16, data.label, data.row, data.fold, data.bins.astype(float))
    train, rest = np.flatnonzero(data.fold), np.flatnonzero(data.fold == 0)
    forest = Spec("forest", trees=8, depth=8, rows="bootstrap", impurity="gini" if classes else "variance")
    members = (forest, Spec("boost", trees=8, depth=3), *([Spec("line", C=1.0)] if classes else []))
    spec = Spec("stack", classes, members=members, final=final, C=0.01 if final == "ridge" else 1.0)
    seen = []
    fit = trees.member_outputs
    try:
        trees.member_outputs = lambda m, d, a, b: seen.append((set(a.tolist()), set(b.tolist()))) or fit(m, d, a, b)
        got = trees.predictions(spec, fit_predict(spec, data, train, rest))
    finally:
        trees.member_outputs = fit
    assert all(not a & b for a, b in seen) and len(seen) == 6 * len(members)
    if classes:
        assert (got == data.label[rest]).mean() > 0.6
    else:
        assert np.corrcoef(got, data.label[rest])[0, 1] > 0.85


def test_a_line_in_memory_equals_the_job(spark):
    from tabwright.operators.models import lines
    data = some_data(200, 2)
    job, w = lines.fit_in_memory(lines.Line(2, C=0.3), data.bins.astype(float), data.label)
    rows = [(int(r), 1, float(y), *map(float, b)) for r, y, b in zip(data.row, data.label, data.bins)]
    split = spark.createDataFrame(rows, "_row long, _fold int, y double, a double, b double, c double, d double")
    jobs = lines.jobs_of(split, ["a", "b", "c", "d"], "y", [lines.Line(2, C=0.3)], 1)
    table = split.select("_fold", F.col("y").alias("_y"), F.array("a", "b", "c", "d").alias("_x"))
    assert np.abs(lines.fit_lines(table, 4, jobs)[0] - w).max() < 1e-6


def test_bins_and_empty_tables(spark):
    rows = spark.createDataFrame([(i, float(i % 7), 1.0, float(i), i % 2) for i in range(50)], "id long, a double, b double, y double, _fold int")
    edges = trees.bin_edges(rows, ["a", "b"], 4)
    table = trees.binned(rows, "id", ["a", "b"], "y", edges).collect()
    assert {tuple(r["_bins"]) for r in table} == {(int(np.searchsorted(edges[0], v)), 0) for v in range(7)} and len(edges[1]) == 1
    empty = trees.binned(rows.limit(0), "id", ["a", "b"], "y", edges)
    assert trees.out_of_fold(empty, 2, [(Spec("forest", trees=2), 0)], 4).collect() == []


def test_models_stay_small(spark, tmp_path):
    """A forest comes back in parts and holds what scoring needs: about ten bytes a node, not the sums it was grown by."""
    import pickle

    rows = spark.range(3_000).select("id", (F.col("id") % 61).cast("double").alias("a"), (F.col("id") * 37 % 101).cast("double").alias("b"),
                                     (F.xxhash64("id") % 1000).cast("double").alias("y"))
    spec = Spec("forest", trees=40, depth=12, rows="bootstrap")
    model = trees.fit_model(rows, "id", ["a", "b"], "y", spec)
    nodes = sum(len(n.feature) for n, _ in model.grown.steps)
    assert nodes > 10_000 and len(pickle.dumps(model.grown)) < 16 * nodes
    data = trees._collected(trees.binned(rows.withColumn("_fold", F.lit(0)), "id", ["a", "b"], "y", model.edges), 2, 64)
    every = np.arange(len(data.label))
    out = trees.scores(spec, model.grown, data.bins, every) + model.centre
    assert np.allclose(out, fit_predict(spec, data, every, every))
    stage = trees.TreeStage(model, "p")
    assert not stage.isSet("ensemble")
    stage.write().save(f"{tmp_path}/stage")
    again = trees.TreeStage.load(f"{tmp_path}/stage")
    assert again.uid == stage.uid
    assert again.transform(rows).select("p").collect() == stage.transform(rows).select("p").collect()


@pytest.mark.parametrize("random_cuts", [False, True])
def test_levels_of_many_rows_go_by_nodes(monkeypatch, random_cuts):
    """The cells of a level are never all in memory; the trees are the same."""
    data, seen = some_data(2_000), []
    spec = Spec("forest", trees=3, depth=9, rows="bootstrap", random_cuts=random_cuts)
    whole = fit_predict(spec, data, np.arange(1_500), np.arange(1_500, 2_000))
    most = trees.cells_of
    monkeypatch.setattr(trees, "ROWS_AT_ONCE", 150)
    monkeypatch.setattr(trees, "cells_of", lambda bins, rows, place, *more: seen.append((len(rows), place.max())) or most(bins, rows, place, *more))
    assert np.allclose(fit_predict(spec, data, np.arange(1_500), np.arange(1_500, 2_000)), whole)
    assert all(n <= 150 or last == 0 for n, last in seen)


def test_a_level_sums_up_drawn_features_only(monkeypatch):
    """Of eight features a node draws two; only these are counted while one of them splits."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 16, (4_000, 8)).astype(np.uint8)
    y = x.sum(1) + rng.normal(size=4_000)
    spec, counted, whole = Spec("forest", depth=5, features="sqrt"), [], trees.Sums.cells
    monkeypatch.setattr(trees.Sums, "cells", lambda self, key, *more: counted.append(len(key)) or whole(self, key, *more))
    stats = trees.forest_stats(spec, y, np.ones(4_000), np.ones(1))
    nodes = grow(spec, x, 16, np.arange(4_000), np.zeros(4_000, np.int64), stats, np.array([0]))
    assert len(nodes.feature) == 63
    assert sum(counted) <= 4_000 * (1 + 5 * 3)  # the root; two features and the sides of each level


@pytest.mark.parametrize("spec", [
    Spec("forest", depth=7, rows="bootstrap"), Spec("forest", 3, depth=7, impurity="gini", rows="bootstrap"),
    Spec("forest", 3, depth=7, impurity="entropy", balanced=True, features="sqrt"), Spec("forest", depth=7, random_cuts=True, min_leaf=4),
    Spec("boost", depth=5, impurity="second", tree_features=0.5, min_child=3)])
def test_sums_in_memory_and_of_cells_choose_alike(spec):
    """The grower's own sums and ``best_splits`` of the cells of a job per level; weights and leaves come out right."""
    data = some_data(600, spec.classes, seed=4)
    weight = trees.row_weights(spec, data.row, 0)
    rows = np.flatnonzero(weight)
    if spec.impurity == "second":
        stats = np.stack([-data.label, np.ones(600), np.ones(600)], 1)[rows]
    else:
        by_class = trees.class_weights(spec, np.bincount(data.label.astype(int)) if spec.classes else None)
        stats = trees.forest_stats(spec, data.label[rows], weight[rows], by_class)
    leaf = np.zeros(len(rows), np.int64)
    nodes = grow(spec, data.bins, 16, rows, np.zeros(len(rows), np.int64), stats, np.array([3]), leaf)
    assert (leaf == nodes.route(data.bins, rows, np.zeros(len(rows), np.int64))).all()
    at, seen = np.zeros(len(rows), np.int64), 0
    for _ in range(spec.depth):
        for n in np.unique(at):
            own = at == n
            assert np.allclose(nodes.stats[n], stats[own].sum(0))
            if own.sum() >= max(2, 2 * spec.min_leaf):
                cells = trees.cells_of(data.bins, rows[own], np.zeros(own.sum(), np.int64), stats[own], 1, 16)
                feature, cut, *_ = trees.best_splits(spec, *cells, nodes.tree[[n]], nodes.path[[n]], 4, 16)
                if nodes.feature[n] >= 0 or nodes.path[n] < 2 ** (spec.depth - 1):
                    assert feature[0] == nodes.feature[n] and (feature[0] < 0 or cut[0] == nodes.cut[n])
                    seen += feature[0] >= 0
        inner = nodes.feature[at] >= 0
        at = np.where(inner, nodes.child[at] + (data.bins[rows, np.maximum(nodes.feature[at], 0)] > nodes.cut[at]), at)
    assert seen > 10


def test_reweighting_merges_rows_alike(monkeypatch):
    """Rows of the same bins and class are one entry with their weight: the same trees as with each row for itself."""
    data = some_data(900, 3, bins=3)
    train, rest = np.flatnonzero(data.fold), np.flatnonzero(data.fold == 0)
    spec, entries, one = Spec("ada", 3, trees=12, depth=2, impurity="gini"), [], trees.grow
    monkeypatch.setattr(trees, "grow", lambda spec, bins, n, rows, *more: entries.append(len(rows)) or one(spec, bins, n, rows, *more))
    found = fit_predict(spec, data, train, rest)
    assert max(entries) <= 3 ** 4 * 3
    monkeypatch.setattr(trees, "alike", lambda data, rows: (rows, np.ones(len(rows))))
    assert np.allclose(found, fit_predict(spec, data, train, rest))
    assert max(entries) == len(train)


@pytest.mark.parametrize("spec", [Spec("forest", trees=3, depth=6, min_split=5, min_leaf=3, rows="bootstrap"),
                                  Spec("forest", classes=2, trees=3, depth=6, min_leaf=2, rows="bootstrap", impurity="gini", balanced=True),
                                  Spec("boost", trees=4, depth=3, min_split=6, min_leaf=4, rows=0.7), Spec("boost", classes=2, trees=4, depth=3, rows=0.7),
                                  Spec("boost", classes=3, trees=4, depth=3, min_leaf=3),
                                  Spec("boost", trees=4, depth=4, impurity="second", l2=1.0, min_child=3.0, rows=0.8)])
def test_rows_of_the_same_bins_grow_as_one(spec, monkeypatch):
    """A tree gets an entry per combination of bins, and gives what an entry per row gives."""
    data, seen = some_data(400, spec.classes, bins=4), []
    every, whole = np.arange(400), trees.grow

    def counted(spec, bins, n_bins, rows, tree, *more, **named):
        seen.append(np.bincount(tree).max())
        return whole(spec, bins, n_bins, rows, tree, *more, **named)
    monkeypatch.setattr(trees, "grow", counted)
    found = fit_predict(spec, data, every, every)
    assert max(seen) <= 4 ** 4 * max(1, spec.classes if spec.kind == "forest" else spec.classes if spec.classes > 2 else 1)
    assert max(seen) < 390
    monkeypatch.setattr(trees.Data, "distinct", lambda self, rows: (rows, np.arange(len(rows))))
    assert np.allclose(found, fit_predict(spec, data, every, every))
    monkeypatch.setattr(trees, "SPARSE", 0)
    assert np.allclose(found, fit_predict(spec, data, every, every))
