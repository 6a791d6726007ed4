"""Trees of merged rows against trees of every row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.operators.models import cells, recipe, regress, trees
from tabwright.operators.models.recipe import Task, fit_regressor, train_regressor
from tabwright.operators.split import split_tables

TASK = Task("id", ("a", "b"), "y")


@pytest.fixture(scope="module")
def table(spark):
    """6 000 rows in 12 x 7 combinations of two features."""
    noise = F.pmod(F.xxhash64("id"), F.lit(1_000)) / 100
    return spark.range(6_000).select(
        "id", (F.col("id") % 12).cast("double").alias("a"), (F.floor(F.col("id") / 12) % 7).cast("double").alias("b")).withColumn(
        "y", F.col("a") * 3 + F.when(F.col("b") > 3, F.col("a")).otherwise(-F.col("b")) + F.when(F.col("id") >= 0, noise)).cache()


def guesses(model, table):
    rows = model.transform(table).select("a", "b", "prediction").distinct().collect()
    return {(r[0], r[1]): r[2] for r in rows}


def test_boosting_merges_rows_and_stays_the_same(table, monkeypatch):
    seen, merged = [], cells.merged
    monkeypatch.setattr(cells, "merged", lambda *a: seen.append(merged(*a)) or seen[-1])
    few = guesses(fit_regressor(table, TASK, regress.gradient_boosting(trees=5)), table)
    assert seen[0][1].count() == 84  # the learner does not see 6 000 rows
    assert seen[0][1].agg(F.sum("_weight")).first()[0] == 6_000
    monkeypatch.setattr(cells, "bins_of", lambda *a: None)
    every = guesses(fit_regressor(table, TASK, regress.gradient_boosting(trees=5)), table)
    assert few.keys() == every.keys() and len(few) == 84
    assert all(np.isclose(few[k], every[k]) for k in few)


def test_forest_sums_up_all_trees_in_one_pass(spark, table, monkeypatch):
    """Each tree equals one grown from the rows themselves, each as often as it is drawn."""
    model = fit_regressor(table, TASK, regress.random_forest(trees=6, depth=15, max_features="all"))
    stage = next(s for s in model.stages if isinstance(s, trees.TreeStage))
    bins = cells.bins_of(model.stages[0].transform(table), TASK)
    rows = table.select("a", "b", "y", F.xxhash64(F.col("id").cast("string")).alias("h")).toPandas()
    found = guesses(model, table)
    total = {k: 0.0 for k in found}
    for t in range(6):
        weight = cells.draws(0.5, rows["h"].to_numpy(), t, 3)
        assert abs(weight.mean() - 0.5) < 0.05 and weight.max() > 1
        own = rows.assign(w=weight, wy=weight * rows["y"]).groupby(["a", "b"])[["w", "wy"]].sum()
        for k in total:  # depth 15 parts all cells
            total[k] += own["wy"][k] / own["w"][k]
    assert len(stage._model.grown.steps) == 6 and len(bins.edges[0]) < cells.N_BINS
    assert all(np.isclose(found[k], total[k] / 6) for k in found)


def test_forest_of_many_cells_takes_the_other_way(spark, table):
    spark.conf.set("tabwright.trees.forestCells", "50")
    try:
        model = train_regressor(table, TASK, regress.random_forest(trees=5, depth=6))
        assert not any(isinstance(s, trees.TreeStage) for s in model.model.stages)
        assert model.report.first()["r2"] > 0.8
    finally:
        spark.conf.unset("tabwright.trees.forestCells")


def test_a_forest_of_cells_predicts_and_is_saved(table, tmp_path):
    fitted = train_regressor(table, TASK, regress.random_forest(trees=20))
    assert fitted.report.first()["r2"] > 0.85
    fitted.model.write().save(f"{tmp_path}/forest")
    again = type(fitted.model).load(f"{tmp_path}/forest")
    assert guesses(again, table) == guesses(fitted.model, table)


def test_drawn_features_round_as_before():
    assert [cells.drawn_features(s, 3) for s in ("0.75", "all", "auto", "sqrt", "log2", "2")] == [3, 3, 1, 2, 2, 2]


def test_merged_rows_are_counted_by_batches(spark, table, monkeypatch):
    """The rows meet as arrays, whose cells are summed before they leave a task, and are the same as by expressions."""
    scaled = table.select(F.col("a").alias("_features_0"), F.col("b").alias("_features_1"), F.col("y").alias("_label"))
    bins = cells.bins_of(scaled, Task("id", ("a", "b"), "y"))
    found = cells.cell_sums(scaled.repartition(3), bins)
    assert found.count() <= 3 * 84
    want = {r[0]: r[1:] for r in bins.cell(scaled).groupBy("_cell").agg(F.count("*"), F.sum("_label")).collect()}
    got = {r[0]: r[1:] for r in found.groupBy("_cell").agg(F.sum("n"), F.sum("y")).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    monkeypatch.setattr(cells, "HELD_CELLS", 40)  # sent on early
    again = {r[0]: r[1:] for r in cells.cell_sums(scaled, bins).groupBy("_cell").agg(F.sum("n"), F.sum("y")).collect()}
    assert all(np.allclose(again[k], want[k]) for k in want)


def test_the_parts_of_a_table_are_told_once(table):
    """No pass over the training rows digests the keys again."""
    train, test = recipe.cached_parts(recipe.prepare(table, TASK, False), TASK)
    want = split_tables(recipe.prepare(table, TASK, False), "id")
    for mine, theirs in zip((train, test), want):
        assert mine.columns == theirs.columns and sorted(mine.collect()) == sorted(theirs.collect())
        plan = mine._jdf.queryExecution().optimizedPlan().toString()
        assert "md5" not in plan.split("InMemoryRelation")[0]
