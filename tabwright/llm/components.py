"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabwright.llm.common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the ends of ``edges`` (a, b): the component is the smallest node reachable.

    Large-star and small-star steps alternate until the edges form stars (Kiveris et al., 2014), a number of rounds that
    grows with the logarithm of the size. Minima are taken in part before each shuffle; a node with many edges is split by
    the joins. Every round is a table in the shared folder, so a lost executor costs at most one round.
    """
    def stars(e: DataFrame) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    current = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    while True:
        current = written(stars(current), "components")
        # done when every node points to one smaller node, and none of those points on
        ends = current.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
            current.select("b", F.lit(0), F.lit(1)))
        loose = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where(
            "up > 1 or up = 1 and down = 1")
        if loose.isEmpty():
            return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
