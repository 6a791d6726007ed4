"""Exact nearest neighbours as a Spark job, and what is built on them: kNN imputation, LOF, SMOTE, kNN models.

The join follows the pivot partitioning of Lu et al., "Efficient Processing of k
Nearest Neighbor Joins using MapReduce" (VLDB 2012): every vector belongs to the
cell of its nearest pivot; distances to the pivots bound how far the neighbours
of a query cell can lie, and a donor travels only to the cells it could serve.
Equal vectors are joined once. Neighbouring query cells are merged up to a block, so
that a donor which serves many cells, as in many dimensions, travels once for all of
them; large cells are cut into blocks of bounded size on both sides, so that neither a dense cell nor a vector shared by a third of the rows ends
up in one task, and each block pair sends on its best k only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabwright.functions.columns import quoted
from tabwright.operators.scale import fit_linear
from tabwright.operators.split import PLACES, hash_place
from tabwright.operators.stats import aggregate_once, quantiles, row_positions
from tabwright.session import checkpointed, setting

MAX_PIVOTS = 65_536  # of one round; the pivots travel with the task closures
PIVOTS_PER_GROUP = 512
FINE_PIVOTS = 8_192  # of all groups of few columns, at most 2 048 each: cells then shrink as rows grow
PATTERNS = 8  # of gaps, up to which each pair of patterns is searched by the columns that both have
QUERY_BLOCK = 16_384  # vectors of one block pair
DONOR_BLOCK = 65_536
MASKED_BLOCKS = 4_096, 16_384  # the same where values are missing
AT_ONCE = 4_000_000  # distances in memory at once
HITS_AT_ONCE = 65_536  # neighbours wanted at once
MASKED_AT_ONCE = 500_000  # the same where values are missing; a dozen tables of that size are held
TIE_DIGITS = 12  # squared distances equal to this many significant digits are ties, settled by id
SLACK = 1e-9  # relative margin of the pruning bounds against rounding


def feature_array(columns: Sequence[str]) -> Column:
    return F.array(*[quoted(c).cast("double") for c in columns])


def _distances(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """Squared Euclidean (p=2) or squared Manhattan (p=1) distances, coordinate by coordinate."""
    total = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        d = a[:, i, None] - b[None, :, i]
        total += d * d if p == 2 else np.abs(d)
    return total if p == 2 else total * total


def _stack(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_numpy()).astype(float)


def _distinct_vectors(points: DataFrame, keep: int) -> DataFrame:
    """(group, features, ids): equal vectors once, with their ``keep`` smallest ids."""
    same = Window.partitionBy("group", "features").orderBy("id")
    first = points.withColumn("_rn", F.row_number().over(same)).where(F.col("_rn") <= keep)
    return first.groupBy("group", "features").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def _pivot_tables(vectors: DataFrame, most: int | None = None) -> dict | None:
    """Per group, vectors chosen by hash: a number that grows with the square root of the group; None if one round is too small."""
    spark = vectors.sparkSession
    limit = setting(spark, "neighbors.maxPivots", MAX_PIVOTS)
    sizes = {r["group"]: r["n"] for r in vectors.groupBy("group").agg(F.count("*").alias("n")).limit(limit + 1).collect()}
    if len(sizes) > limit:
        return None
    share = max(1, min(setting(spark, "neighbors.pivotsPerGroup", most or PIVOTS_PER_GROUP), limit // max(1, len(sizes))))
    wanted = {g: max(1, min(share, ceil(sqrt(n) / 2))) for g, n in sizes.items()}
    order = Window.partitionBy("group").orderBy(F.xxhash64("features"), "features")
    rows = vectors.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= share)
    chosen: dict = {}
    for r in rows.select("group", "features", "_rn").orderBy("group", "_rn").collect():  # at most ``limit`` rows
        if r["_rn"] <= wanted[r["group"]]:
            chosen.setdefault(r["group"], []).append(r["features"])
    return {g: np.array(v, dtype=float) for g, v in chosen.items()}


def _by_group(groups: pd.Series):
    for g, index in groups.groupby(groups, sort=False, dropna=False).groups.items():
        yield g, groups.index.get_indexer(index)


def _assign(vectors: DataFrame, pivots: dict, p: int) -> DataFrame:
    """Add ``cell`` (nearest pivot) and ``reach`` (distance to it); groups without donors drop out."""
    @F.pandas_udf("cell int, reach double")
    def nearest(group: pd.Series, features: pd.Series) -> pd.DataFrame:
        cell, reach = np.full(len(group), -1), np.zeros(len(group))
        for g, at in _by_group(group):
            if g in pivots:
                for start in range(0, len(at), 1024):
                    part = at[start:start + 1024]
                    d = _distances(_stack(features.iloc[part]), pivots[g], p)
                    cell[part] = d.argmin(axis=1)
                    reach[part] = np.sqrt(d.min(axis=1))
        return pd.DataFrame({"cell": cell, "reach": reach})
    return vectors.withColumn("_a", nearest("group", "features")).select("*", "_a.cell", "_a.reach").drop("_a").where(
        F.col("cell") >= 0)


def _bounds(queries: DataFrame, donors: DataFrame, pivots: dict, k: int, p: int) -> dict:
    """Per group: radius of each query cell, and a distance within which it has k donors."""
    radius = {(r["group"], r["cell"]): r["u"] for r in queries.groupBy("group", "cell").agg(
        F.max("reach").alias("u")).collect()}  # one row per pivot
    close = donors.withColumn("_rn", F.row_number().over(Window.partitionBy("group", "cell").orderBy("reach"))).where(
        F.col("_rn") <= k)
    near: dict = {}
    for r in close.select("group", "cell", "reach", F.size("ids").alias("w")).collect():  # at most k rows per pivot
        near.setdefault(r["group"], []).append((r["cell"], r["reach"], r["w"]))
    result = {}
    for g, table in pivots.items():
        between = np.sqrt(_distances(table, table, p))
        u = np.array([radius.get((g, c), np.nan) for c in range(len(table))])
        rows = near.get(g, [])
        cells = np.array([x[0] for x in rows], dtype=int)
        reach, weight = np.array([x[1] for x in rows]), np.array([x[2] for x in rows])
        theta = np.full(len(table), np.inf)
        for c in np.flatnonzero(~np.isnan(u)):
            upper = u[c] + between[c, cells] + reach
            order = np.argsort(upper)
            enough = np.searchsorted(np.cumsum(weight[order]), k)
            if enough < len(order):
                theta[c] = upper[order[enough]]
        result[g] = (u, theta, between)
    return result


def _merged_cells(queries: DataFrame, pivots: dict, limit: int) -> dict:
    """Per group, the number of the merged cell that each cell belongs to: neighbouring ones of at most ``limit`` vectors."""
    load: dict = {}
    for r in queries.groupBy("group", "cell").agg(F.count("*").alias("n")).collect():  # one row per pivot
        load.setdefault(r["group"], {})[r["cell"]] = r["n"]
    result = {}
    for g, sizes in load.items():
        cells = np.array(sorted(sizes))
        result[g] = np.full(len(pivots[g]), -1)
        for i, part in enumerate(_cell_groups(cells, np.array([sizes[c] for c in cells]), pivots[g], limit)):
            result[g][part] = i
    return result


def _targets(donors: DataFrame, pivots: dict, bounds: dict, parts: dict, p: int) -> DataFrame:
    """Add ``serves``: the merged query cells a donor could have a neighbour in."""
    @F.pandas_udf("array<int>")
    def serves(group: pd.Series, features: pd.Series, cell: pd.Series) -> pd.Series:
        out = np.empty(len(group), dtype=object)
        for g, at in _by_group(group):
            if g not in parts:  # no queries
                for row in at:
                    out[row] = np.zeros(0, "int32")
                continue
            table, (u, theta, between) = pivots[g], bounds[g]
            for start in range(0, len(at), 1024):
                part = at[start:start + 1024]
                d = np.sqrt(_distances(_stack(features.iloc[part]), table, p))
                own = cell.iloc[part].to_numpy()
                margin = SLACK * (1 + d + np.nan_to_num(u)[None, :])
                keep = (d - u[None, :] <= theta[None, :] + margin) & ~np.isnan(u)[None, :]
                if p == 2:  # distance to the plane between the two cells
                    gap = between[own]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        plane = np.where(gap > 0, (d ** 2 - d[np.arange(len(part)), own][:, None] ** 2) / (2 * gap), -np.inf)
                    keep &= plane <= theta[None, :] + margin
                for row, mask in zip(part, keep):
                    out[row] = np.unique(parts[g][mask]).astype("int32")
        return pd.Series(out)
    return donors.withColumn("serves", serves("group", "features", "cell"))


def _best(distances: np.ndarray, k: int, error: np.ndarray | float = 0.0, finite: bool = True) -> np.ndarray:
    """Mask of the entries that can be among the k smallest of their row, ties included; each may be off by ``error``.

    The least values of many stretches of columns bound the k-th smallest of the row from above, if all are ``finite``.
    """
    n = distances.shape[1]
    if n <= k:
        return np.ones_like(distances, dtype=bool)
    stretch = max(1, n // (16 * k)) if finite else 1
    least = np.minimum.reduceat(distances, np.arange(0, n, stretch), axis=1) if stretch > 1 else distances
    cut = np.partition(least, k - 1, axis=1)[:, k - 1]
    return distances <= (cut + 2 * error + SLACK * (1 + np.abs(cut)))[:, None]


def _nearest_pairs(a: np.ndarray, b: np.ndarray, k: int, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``a`` and ``b``, and their squared distance: all pairs that can be among the k nearest of a row of ``a``.

    One matrix product ranks Euclidean distances with a bound of its error; what it leaves open is measured again by coordinates.
    """
    centre = b.mean(axis=0)
    x, y = a - centre, b - centre
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    given = np.column_stack([y, yy]).T
    error = 1e-15 * (a.shape[1] + 16) * 4 * (xx + yy.max()) + 1e-15 * a.shape[1] * (a * a).max(1, initial=0.0)
    error += 1e-15 * a.shape[1] * (centre * centre).max(initial=0.0)
    finite, found, size = bool(np.isfinite(error).all()), [], max(1, AT_ONCE // len(b))
    for start in range(0, len(a), size):
        stop = min(len(a), start + size)
        if p == 1 or not finite:
            row, col = np.nonzero(_best(_distances(a[start:stop], b, p), k, finite=finite))
        else:
            rough = np.column_stack([-2 * x[start:stop], np.ones(stop - start)]) @ given
            row, col = np.nonzero(_best(rough, k, error[start:stop] + SLACK * xx[start:stop]))
        found.append((row + start, col))
    row, col = (np.concatenate(f) for f in zip(*found))
    exact = np.zeros(len(row))
    for i in range(a.shape[1]):
        d = a[row, i] - b[col, i]
        exact += d * d if p == 2 else np.abs(d)
    return row, col, exact if p == 2 else exact * exact


def _needed(row: np.ndarray, col: np.ndarray, d2: np.ndarray, copies: np.ndarray, need: int) -> tuple[np.ndarray, ...]:
    """The pairs, by row and distance, and their distances for ties: without vectors behind ``need`` ids of nearer ones."""
    tie = significant(d2)
    order = np.lexsort((tie, row))
    row, col, d2, tie = row[order], col[order], d2[order], tie[order]
    nearer = np.cumsum(copies[col]) - copies[col]
    at = np.arange(len(row))
    other = np.concatenate([[True], row[1:] != row[:-1]])
    own = np.maximum.accumulate(np.where(other, at, 0))
    equal = np.maximum.accumulate(np.where(other | np.concatenate([[True], tie[1:] != tie[:-1]]), at, 0))
    kept = nearer[equal] - nearer[own] < need
    return row[kept], col[kept], d2[kept], tie[kept]


def knn_join(queries: DataFrame, donors: DataFrame, k: int, exclude_self: bool = False, p: int = 2,
             pivots_per_group: int | None = None) -> DataFrame:
    """The exact ``k`` nearest donors of every query inside its group.

    Both sides have (group, id, features array<double>); the result is
    (group, query_id, donor_id, distance, rank). ``exclude_self`` skips the donor
    with the query's own id. Distances equal to nine digits are ties and go by id.
    """
    need = k + 1 if exclude_self else k
    # fresh column identities: both sides may be the same table
    queries, donors = (side.select(*[F.col(c).alias(c) for c in ("group", "id", "features")])
                       for side in (queries, donors))
    donor_vectors = checkpointed(_distinct_vectors(donors, need))
    pivots = _pivot_tables(donor_vectors, pivots_per_group)
    if pivots is None:
        return _in_rounds(queries, donors, donor_vectors, k, exclude_self, p)
    query_vectors = checkpointed(_assign(queries.groupBy("group", "features").agg(F.min("id").alias("vid")), pivots, p))
    placed = _assign(donor_vectors, pivots, p)
    bounds = _bounds(query_vectors, placed, pivots, need, p)
    spark = queries.sparkSession
    qb, db = setting(spark, "neighbors.queryBlock", QUERY_BLOCK), setting(spark, "neighbors.donorBlock", DONOR_BLOCK)
    parts = _merged_cells(query_vectors, pivots, qb)
    located = checkpointed(_targets(placed, pivots, bounds, parts, p)).drop("cell", "reach").withColumn(
        "cell", F.explode("serves")).drop("serves")
    group_type = dict(queries.dtypes)["group"]
    members = spark.createDataFrame([(g, int(c), int(of[c])) for g, of in parts.items() for c in np.flatnonzero(of >= 0)],
                                    f"group {group_type}, cell int, _part int")  # one row per pivot
    query_vectors = query_vectors.join(F.broadcast(members), ["group", "cell"]).drop("cell").withColumnRenamed("_part", "cell")
    # blocks of bounded size on both sides of a merged cell
    load = query_vectors.groupBy("group", "cell").agg(F.count("*").alias("nq")).join(
        located.groupBy("group", "cell").agg(F.count("*").alias("nd")), ["group", "cell"])
    blocks = load.select("group", "cell", F.ceil(F.col("nq") / qb).cast("int").alias("qs"),
                         F.ceil(F.col("nd") / db).cast("int").alias("ds"))
    blocks = F.broadcast(spark.createDataFrame(blocks.toArrow(), schema=blocks.schema))  # one row per pivot

    def cut(side: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("features"), F.col(own)).cast("int")
        all_of_other = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        return side.join(blocks, ["group", "cell"]).select(
            *[c for c in side.columns], mine.alias(f"_{own}"), all_of_other.alias(f"_{other}"))

    left = cut(query_vectors.drop("reach"), "qs", "ds")
    right = cut(located, "ds", "qs")
    id_type = dict(queries.dtypes)["id"]

    def nearest(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"at": [], "donor_id": [], "d2": []})]
        if len(q) and len(d):
            copies = d["ids"].map(len).to_numpy()
            starts, ids = np.cumsum(copies) - copies, np.concatenate(d["ids"].to_numpy())
            asked, given, size = _stack(q["features"]), _stack(d["features"]), max(1, HITS_AT_ONCE // need)
            for start in range(0, len(asked), size):
                row, col, d2 = _nearest_pairs(asked[start:start + size], given, need, p)
                row, col, d2, tie = _needed(row, col, d2, copies, need)
                n = copies[col]
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                hits = pd.DataFrame({"at": np.repeat(row + start, n), "donor_id": ids[np.repeat(starts[col], n) + within],
                                     "d2": np.repeat(d2, n), "tie": np.repeat(tie, n)})
                found.append(hits.sort_values(["at", "tie", "donor_id"]).groupby("at").head(need).drop(columns="tie"))
        best = pd.concat(found[1:] or found, ignore_index=True)
        at = best["at"].to_numpy(dtype=int)
        return pd.DataFrame({"group": q["group"].to_numpy()[at], "vid": q["vid"].to_numpy()[at],
                             "donor_id": best["donor_id"].to_numpy(), "d2": best["d2"].to_numpy()})

    keys = ["group", "cell", "_qs", "_ds"]
    partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        nearest, f"group {group_type}, vid {id_type}, donor_id {id_type}, d2 double")

    def ranked(df: DataFrame, owner: str, limit: int) -> DataFrame:
        order = Window.partitionBy("group", owner).orderBy(significant_column("d2"), "donor_id")
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)

    best = ranked(partial, "vid", need)
    named = queries.join(query_vectors.select("group", "features", "vid"), ["group", "features"]).select(
        "group", F.col("id").alias("query_id"), "vid")

    def of_rows(named: DataFrame) -> DataFrame:
        """The neighbours of equal vectors stay together in one array, which rows take their own id out of."""
        lists = best.groupBy("group", "vid").agg(F.array_sort(F.collect_list(F.struct("rank", "donor_id", "d2"))).alias("_near"))  # ``need``
        near = F.col("_near")
        if exclude_self:
            near = F.slice(F.filter(near, lambda x: x["donor_id"] != F.col("query_id")), 1, k)
        return named.join(lists, ["group", "vid"]).select("group", "query_id", F.posexplode(near).alias("_at", "_n")).select(
            "group", "query_id", "_n.donor_id", F.sqrt("_n.d2").alias("distance"), (F.col("_at") + 1).alias("rank"))

    def of_ids(named: DataFrame) -> DataFrame:
        """The rows of an id share its neighbours."""
        found = named.join(best.drop("rank"), ["group", "vid"])
        if exclude_self:
            found = found.where(F.col("query_id") != F.col("donor_id"))
        return ranked(found, "query_id", k).select("group", "query_id", "donor_id", F.sqrt("d2").alias("distance"), "rank")
    repeated = checkpointed(queries.groupBy(F.col("group").alias("_g"), F.col("id").alias("_i")).agg(F.count("*").alias("n")).where("n > 1"))
    if repeated.isEmpty():
        return of_rows(named)
    again = F.col("group").eqNullSafe(F.col("_g")) & F.col("query_id").eqNullSafe(F.col("_i"))
    return of_rows(named.join(repeated, again, "left_anti")).unionByName(of_ids(named.join(repeated, again, "left_semi")))


def _in_rounds(queries: DataFrame, donors: DataFrame, donor_vectors: DataFrame, k: int, exclude_self: bool, p: int) -> DataFrame:
    """The join for groups beyond those of one round: every round takes the next groups and has its own pivots."""
    limit = setting(queries.sparkSession, "neighbors.maxPivots", MAX_PIVOTS)
    numbered = checkpointed(row_positions(donor_vectors.select("group").distinct(), ["group"]).select(
        F.col("group"), F.floor(F.col("position") / limit).alias("_round")))
    found = None
    for i in range(aggregate_once(numbered, {"n": F.max("_round")})["n"] + 1):
        mine = numbered.where(F.col("_round") == i).select("group")
        part = checkpointed(knn_join(*[side.join(mine, "group", "left_semi") for side in (queries, donors)], k, exclude_self, p))
        found = part if found is None else found.unionByName(part)
    return found


def significant(values: np.ndarray) -> np.ndarray:
    """Values at TIE_DIGITS significant digits, whatever their scale; below 1e-280 as they are."""
    large = values > 1e-280
    unit = 10.0 ** (TIE_DIGITS - np.ceil(np.log10(np.where(large, values, 1.0))))
    return np.where(large, np.round(values * unit) / unit, values)


def significant_column(name: str) -> Column:
    unit = F.pow(F.lit(10.0), TIE_DIGITS - F.ceil(F.log10(name)))
    return F.when(F.col(name) > 1e-280, F.round(F.col(name) * unit) / unit).otherwise(F.col(name))


def one_group(df: DataFrame, id_col: str, features: Column) -> DataFrame:
    """All rows as one group; a row with a null feature has no place among the others and is left out."""
    return df.select(F.lit(0).alias("group"), quoted(id_col).alias("id"), features.alias("features")).where(
        ~F.exists("features", lambda x: x.isNull()))


def _boxes(vectors: DataFrame, width: int) -> pd.DataFrame:
    """Per cell: number of vectors ``n``; per column the values ``k``, their least ``lo`` and greatest ``hi``."""
    stats = []
    for i in range(width):
        x = F.col("v")[i]
        stats += [F.count(x).alias(f"k{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    return vectors.groupBy("cell").agg(F.count("*").alias("n"), *stats).orderBy("cell").toPandas()  # one row per pivot


def _cell_groups(cells: np.ndarray, load: np.ndarray, pivots: np.ndarray, limit: int) -> list[np.ndarray]:
    """Cells merged into neighbouring groups of at most ``limit`` vectors, or of one cell."""
    if len(cells) == 1 or load.sum() <= limit:
        return [cells]
    axis = np.ptp(pivots[cells], axis=0).argmax()
    order = np.argsort(pivots[cells, axis], kind="stable")
    half = len(cells) // 2
    return [g for part in (order[:half], order[half:]) for g in _cell_groups(cells[part], load[part], pivots, limit)]


class _Side:
    """Groups of cells of one side of the masked search, with their boxes and numbers of blocks."""

    def __init__(self, vectors: DataFrame, width: int, pivots: np.ndarray, block: int):
        boxes = _boxes(vectors, width)
        cells, n = boxes["cell"].to_numpy(int), boxes["n"].to_numpy(int)
        groups = _cell_groups(cells, n, pivots, block) if len(cells) else []
        part = {c: i for i, c in enumerate(cells)}
        at = [np.array([part[c] for c in g]) for g in groups]
        table = {x: boxes[[f"{x}{i}" for i in range(width)]].to_numpy(float) for x in ("k", "lo", "hi")}
        self.count = np.array([n[i].sum() for i in at])
        self.values = np.array([table["k"][i].sum(0) for i in at]).reshape(len(at), width)
        low, high = np.where(table["k"] > 0, table["lo"], np.inf), np.where(table["k"] > 0, table["hi"], -np.inf)
        self.low = np.array([low[i].min(0) for i in at]).reshape(len(at), width)
        self.high = np.array([high[i].max(0) for i in at]).reshape(len(at), width)
        self.blocks = -(-self.count // block)
        of_cell = pd.DataFrame({"cell": np.concatenate([*groups, []]).astype(int),
                                "g": np.repeat(np.arange(len(groups)), [len(g) for g in groups])})
        self.vectors = vectors.join(F.broadcast(vectors.sparkSession.createDataFrame(of_cell, "cell int, g int")), "cell").drop("cell")


def _least_masked(asked: _Side, given: _Side) -> np.ndarray:
    """Lower bounds of the masked squared distance between groups; infinite where no column can be shared.

    The distance is the width times the mean over the shared columns, which include
    those that no row of either group lacks; any others are shared by some pairs.
    """
    width, out = asked.values.shape[1], np.full((len(asked.count), len(given.count)), np.inf)
    for g in range(len(asked.count)):
        possible = (given.values > 0) & (asked.values[g] > 0)
        always = possible & (given.values == given.count[:, None]) & (asked.values[g] == asked.count[g])
        with np.errstate(invalid="ignore"):
            gap = np.maximum(np.maximum(given.low - asked.high[g], asked.low[g] - given.high), 0.0) ** 2
        some = np.sort(np.where(possible & ~always, gap, np.inf), axis=1)
        total = np.cumsum(np.column_stack([np.where(always, gap, 0.0).sum(1), some]), axis=1)
        number = always.sum(1)[:, None] + np.arange(width + 1)
        mean = np.where(number > 0, total / np.maximum(number, 1), np.inf)
        out[g] = width * mean.min(1)
    return out


def _masked_offers(queries: np.ndarray, donors: np.ndarray, ids: Sequence, k: int) -> dict[str, np.ndarray]:
    """(at, c, donor, d2, x): for each gap ``c`` of each query the ``k`` best donors, as positions in ``ids``.

    Three matrix products give all distances with an error bound; what can be among
    the best is measured again coordinate by coordinate. ``ids`` has the ids of each
    donor vector.
    """
    width, copies = donors.shape[1], np.array([len(x) for x in ids])
    starts, rank = np.cumsum(copies) - copies, pd.factorize(np.concatenate(ids), sort=True)[0]
    there = ~np.isnan(donors)
    centre = np.where(there, donors, 0.0).sum(0) / np.maximum(there.sum(0), 1)
    dx, dm = np.where(there, donors - centre, 0.0), there.astype(float)
    found: list[tuple] = []
    size = max(1, MASKED_AT_ONCE // max(1, len(donors)))
    for start in range(0, len(queries), size):
        q = queries[start:start + size]
        has = ~np.isnan(q)
        qx, qm = np.where(has, q - centre, 0.0), has.astype(float)
        shared = qm @ dm.T
        scale = np.where(shared > 0, width / np.maximum(shared, 1), np.inf)
        squares = (qx * qx) @ dm.T + qm @ (dx * dx).T
        with np.errstate(invalid="ignore"):
            near = np.where(shared > 0, (squares - 2 * (qx @ dx.T)) * scale, np.inf)
            error = np.where(shared > 0, 1e-12 * (1 + squares) * scale, 0.0)
        for c in range(width):
            rows, cols = np.flatnonzero(~has[:, c]), np.flatnonzero(there[:, c])
            if not len(rows) or not len(cols):
                continue
            at = np.ix_(rows, cols)
            upper = near[at] + error[at]
            cut = np.partition(upper, k - 1, axis=1)[:, k - 1] if len(cols) > k else np.full(len(rows), np.inf)
            r, d = np.nonzero((near[at] - error[at] <= (cut * (1 + SLACK))[:, None]) & (shared[at] > 0))
            r, d = rows[r], cols[d]
            d2, both = np.zeros(len(r)), np.zeros(len(r))
            for i in range(width):
                gap = q[r, i] - donors[d, i]
                both += ~np.isnan(gap)
                d2 += np.where(np.isnan(gap), 0.0, gap * gap)
            d2 *= width / both
            n = copies[d]
            donor = np.repeat(starts[d], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            r, d, d2 = (np.repeat(x, n) for x in (r, d, d2))
            order = np.lexsort((rank[donor], significant(d2), r))
            r = r[order]
            first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else r
            place = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)]))
            keep = order[place < k]
            found.append((r[place < k] + start, np.full(len(keep), c), donor[keep], d2[keep], donors[d[keep], c]))
    parts = list(zip(*found)) or [[np.zeros(0)]] * 5
    return dict(zip(("at", "c", "donor", "d2", "x"), map(np.concatenate, parts)))


def _masked_neighbours(points: DataFrame, width: int, means: Sequence[float], k: int) -> DataFrame | None:
    """(v, c, donor_id, d2, x, rank): the ``k`` nearest rows with a value in column ``c`` for each vector ``v`` that lacks it.

    ``points`` has (id, v), NULL where a value is missing. Vectors lie in cells of pivots, with gaps at the column mean;
    cells are merged into groups of bounded load, cut into blocks where one cell is too large. A first pass takes the groups
    with the nearest boxes and shows how far the neighbours can be; a second one takes all groups whose box may reach so far.
    """
    spark, id_type = points.sparkSession, dict(points.dtypes)["id"]
    valued = points.where(F.exists("v", F.isnotnull))
    vectors = _distinct_vectors(valued.select(F.lit(0).alias("group"), "id", F.col("v").alias("features")), k).select(
        "group", F.col("features").alias("v"), "ids")
    filled = checkpointed(vectors.withColumn("features", F.array(*[
        F.coalesce(F.col("v")[i], F.lit(float(means[i] or 0.0))) for i in range(width)])))
    pivots = _pivot_tables(filled.select("group", "features"))
    if not pivots:
        return None
    placed = checkpointed(_assign(filled, pivots, 2).select("cell", "v", "ids"))
    # fresh column identities, since the two sides are joined
    incomplete = placed.where(F.exists("v", F.isnull)).select(*[F.col(c).alias(c) for c in ("cell", "v")])
    asked = _Side(incomplete, width, pivots[0], setting(spark, "neighbors.queryBlock", MASKED_BLOCKS[0]))
    given = _Side(placed, width, pivots[0], setting(spark, "neighbors.donorBlock", MASKED_BLOCKS[1]))
    if not len(asked.count):
        return None
    least = _least_masked(asked, given)
    gaps = asked.count[:, None] - asked.values
    first = np.zeros(least.shape, dtype=bool)
    for g in range(len(least)):
        order = np.argsort(least[g], kind="stable")
        enough = (np.cumsum(given.values[order], axis=0) >= k) | (gaps[g] == 0)
        last = np.flatnonzero(enough.all(1))
        first[g, order[:last[0] + 1 if len(last) else len(order)]] = True
    first &= np.isfinite(least)

    def offers(wanted: np.ndarray) -> DataFrame:
        qg, dg = np.nonzero(wanted)
        pairs = pd.DataFrame({"qg": qg, "dg": dg, "qs": asked.blocks[qg], "ds": given.blocks[dg]})
        pairs = F.broadcast(spark.createDataFrame(pairs, "qg int, dg int, qs int, ds int"))  # at most pivots squared

        def dealt(side: _Side, group: str, own: str, other: str) -> DataFrame:
            rows = side.vectors.withColumnRenamed("g", group).join(pairs, group)
            return rows.withColumn(f"_{own}", F.pmod(F.xxhash64("v"), F.col(own)).cast("int")).withColumn(
                f"_{other}", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("qs", "ds")
        left, right = dealt(asked, "qg", "qs", "ds"), dealt(given, "dg", "ds", "qs")

        def nearest(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
            names = ["g", "v", "c", "donor_id", "d2", "x"]
            d = d[d["ids"].map(len) > 0]
            if not len(q) or not len(d):
                return pd.DataFrame({n: [] for n in names})
            hits = _masked_offers(_stack(q["v"]), _stack(d["v"]), list(d["ids"]), k)
            at, donor = hits["at"].astype(int), hits["donor"].astype(int)
            return pd.DataFrame({"g": q["qg"].to_numpy()[at], "v": q["v"].to_numpy()[at], "c": hits["c"].astype(int),
                                 "donor_id": np.concatenate(list(d["ids"]))[donor], "d2": hits["d2"], "x": hits["x"]})
        keys = ["qg", "dg", "_qs", "_ds"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
            nearest, f"g int, v array<double>, c int, donor_id {id_type}, d2 double, x double")

    def ranked(df: DataFrame) -> DataFrame:
        order = Window.partitionBy("v", "c").orderBy(significant_column("d2"), "donor_id")
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    best = checkpointed(ranked(offers(first)))
    reach = {r["g"]: (r["n"], r["far"]) for r in best.where(F.col("rank") == k).groupBy("g").agg(
        F.count("*").alias("n"), F.max("d2").alias("far")).collect()}  # one row per group
    # a group with a gap that has fewer than k offers yet takes every other group
    far = np.array([reach[g][1] if g in reach and reach[g][0] == gaps[g].sum() else np.inf for g in range(len(gaps))])
    more = np.isfinite(least) & ~first & (least * (1 - SLACK) <= far[:, None])
    return ranked(best.drop("rank").unionByName(offers(more))) if more.any() else best


def _pattern_neighbours(points: DataFrame, width: int, k: int) -> DataFrame | None:
    """``_masked_neighbours`` where rows have few patterns of gaps; None where they have more than ``PATTERNS``.

    All queries of one pattern share the same columns with all donors of another: each pair of patterns is a group of one
    join over just these columns, whose cells lie as close in them as the rows do. The best of all groups count.
    """
    spark, full = points.sparkSession, (1 << width) - 1
    if width > 60:
        return None
    mask = reduce(lambda a, b: a + b, [F.when(F.col("v")[i].isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i in range(width)])
    points = points.withColumn("_mask", mask)
    most = setting(spark, "neighbors.patterns", PATTERNS)
    masks = [r["_mask"] for r in points.select("_mask").distinct().limit(most + 1).collect()]
    if len(masks) > most:
        return None
    pairs = sorted((q, d) for q in masks for d in masks if q & ~d and full & ~(q | d))
    if not pairs:
        return points.select("v", F.lit(0).alias("c"), F.lit(0.0).alias("x")).limit(0)
    queries = checkpointed(points.where(F.col("_mask").isin([q for q, _ in pairs])).select("v", "_mask").distinct().withColumn(
        "_q", F.monotonically_increasing_id()))
    # ids may repeat: a row's place in their order is its own
    donors = checkpointed(row_positions(points.where(F.col("_mask").isin([d for _, d in pairs]) & F.col("id").isNotNull()),
                                        ["id", "v"], name="_n").select("_n", "v", "_mask"))

    def grouped(rows: DataFrame, own: int, id_col: str) -> DataFrame:
        parts = [F.when(F.col("_mask") == pair[own], F.struct(F.lit(g).alias("group"), F.array(*[
            F.col("v")[i] for i in range(width) if not (pair[0] | pair[1]) >> i & 1]).alias("features"))) for g, pair in enumerate(pairs)]
        return rows.select(F.col(id_col).alias("id"), F.explode(F.array_compact(F.array(*parts))).alias("s")).select("s.group", "id", "s.features")
    near = knn_join(grouped(queries, 0, "_q"), grouped(donors, 1, "_n"), k,
                    pivots_per_group=max(PIVOTS_PER_GROUP, min(2_048, FINE_PIVOTS // len(pairs))))
    table = [(g, width / (full & ~(q | d)).bit_count(), [i for i in range(width) if (q & ~d) >> i & 1]) for g, (q, d) in enumerate(pairs)]
    table = F.broadcast(spark.createDataFrame(table, "group int, _scale double, _gaps array<int>"))  # one row per pair of patterns
    found = near.join(table, "group").select("query_id", "donor_id", (F.col("distance") * F.col("distance") * F.col("_scale")).alias("d2"),
                                             F.explode("_gaps").alias("c"))
    order = Window.partitionBy("query_id", "c").orderBy(significant_column("d2"), "donor_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    given = donors.select(F.col("_n").alias("donor_id"), F.col("v").alias("_v"))
    filled = best.join(given, "donor_id").select("query_id", "c", F.get("_v", "c").alias("x"))
    return filled.join(queries.select(F.col("_q").alias("query_id"), "v"), "query_id").select("v", "c", "x")


def impute_knn(df: DataFrame, columns: Sequence[str], id_col: str | Sequence[str], k: int = 5) -> DataFrame:
    """Fill with the mean of the ``k`` nearest rows that have the value.

    Distances use the given columns that both rows have, scaled up by the share
    that is missing. Rows without any common value fall back to the column mean.
    There is no limit on columns or on the combinations of gaps. Few combinations
    are joined pair by pair, more by boxes around cells; where these exclude little,
    as in many dimensions, all blocks of rows meet.
    """
    id_col = id_col if isinstance(id_col, str) else id_col[0]
    total = aggregate_once(df, {f"{k_}{i}": e for i, c in enumerate(columns) for k_, e in (
        ("n", F.count_if(quoted(c).isNull())), ("m", F.avg(quoted(c).cast("double"))))})
    columns_used = [c for i, c in enumerate(columns) if total[f"n{i}"]]
    means = {c: total[f"m{i}"] for i, c in enumerate(columns)}
    if not columns_used:
        return df
    vector = F.transform(F.array(*[quoted(c).cast("double") for c in columns_used]), lambda x: F.nullif(x, F.lit(float("nan"))))
    points = df.select(quoted(id_col).alias("id"), vector.alias("v"))
    near = _pattern_neighbours(points, len(columns_used), k)
    if near is None:
        near = _masked_neighbours(points, len(columns_used), [means[c] for c in columns_used], k)
    joined = df
    if near is not None:
        best = near.groupBy(F.col("v").alias("_v")).agg(*[
            F.avg(F.when(F.col("c") == i, F.col("x"))).alias(f"_k{i}") for i in range(len(columns_used))])
        joined = df.withColumn("_w", vector).join(best, F.col("_w") == F.col("_v"), "left")
    return joined.withColumns({c: F.coalesce(
        quoted(c).cast("double"), *([F.col(f"_k{i}")] if near is not None else []), F.lit(means[c]))
        for i, c in enumerate(columns_used)}).select(*[quoted(c) for c in df.columns])


def lof_scores(df: DataFrame, id_col: str, features: Column, k: int = 20) -> DataFrame:
    """(id, score): local outlier factor, about 1 inside a cluster and larger outside."""
    points = one_group(df, id_col, features)
    near = checkpointed(knn_join(points, points, k, exclude_self=True))
    widest = near.groupBy(F.col("query_id").alias("donor_id")).agg(F.max("distance").alias("_kd"))
    density = near.join(widest, "donor_id").groupBy("query_id").agg(
        (1 / (F.avg(F.greatest("_kd", "distance")) + 1e-10)).alias("_lrd"))
    density = checkpointed(density)
    other = density.select(F.col("query_id").alias("donor_id"), F.col("_lrd").alias("_other"))
    return near.join(other, "donor_id").groupBy("query_id").agg(F.avg("_other").alias("_mean")).join(
        density, "query_id").select(F.col("query_id").alias(id_col), (F.col("_mean") / F.col("_lrd")).alias("score"))


def outlier_lof(df: DataFrame, id_col: str, columns: Sequence[str], k: int = 20, contamination: float = 0.1) -> DataFrame:
    """Add ``score`` and ``is_outlier``; gaps take the column mean, the highest scores are flagged."""
    means = aggregate_once(df, {c: F.avg(quoted(c).cast("double")) for c in columns})
    features = F.array(*[F.coalesce(quoted(c).cast("double"), F.lit(means[c])) for c in columns])
    scores = checkpointed(lof_scores(df, id_col, features, k))
    cut = quantiles(scores.select((-F.col("score")).alias("s")), ["s"], [contamination])["s"][0]
    return df.join(scores.withColumn("is_outlier", (-F.col("score") < cut).cast("int")), id_col)


def lof_top(scored: DataFrame, id_col: str, n: int = 20) -> DataFrame:
    return scored.select(quoted(id_col), "score").orderBy(F.desc("score"), quoted(id_col)).limit(n)


def smote(df: DataFrame, id_col: str, columns: Sequence[str], target: str, k: int = 5, seed: int = 42) -> DataFrame:
    """(target, columns, synthetic): all rows, and interpolated ones that bring every class to the size of the largest.

    A new point lies between a row and one of its ``k`` nearest rows of the same
    class; row, neighbour and place follow from hashes, so a rerun gives the same
    points. A class with a single row cannot be interpolated and stays as it is.
    """
    sizes = {r["c"]: r["n"] for r in df.groupBy(quoted(target).alias("c")).agg(F.count("*").alias("n")).collect()}
    most = max(sizes.values())
    plan = [(c, most - n, n) for c, n in sizes.items() if c is not None and 1 < n < most]
    real = df.select(quoted(target), *[quoted(c).cast("double").alias(c) for c in columns], F.lit(0).alias("synthetic"))
    if not plan:
        return real
    spark = df.sparkSession
    target_type = df.schema[target].dataType.simpleString()
    table = F.broadcast(spark.createDataFrame(plan, f"group {target_type}, lack long, size long"))  # one row per class
    points = df.select(quoted(target).alias("group"), quoted(id_col).alias("id"), feature_array(columns).alias("features"))
    minority = points.join(table, "group")
    near = knn_join(minority, minority, k, exclude_self=True)
    choices = near.groupBy("group", F.col("query_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "donor_id"))).alias("near"))  # k entries per row
    shuffled = minority.withColumn("_h", F.xxhash64("id", F.lit(seed)))
    turn = row_positions(shuffled, ["_h", "id"], ["group"], "_pos")
    # copies of a row: lack / size each, and one more for the first lack % size rows
    copies = F.floor(F.col("lack") / F.col("size")) + F.when(F.col("_pos") < F.col("lack") % F.col("size"), 1).otherwise(0)
    made = turn.withColumn("_copies", copies.cast("int")).where(F.col("_copies") > 0).withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).join(choices, ["group", "id"])
    pick = F.pmod(F.xxhash64("id", "_copy", F.lit(seed), F.lit("neighbour")), F.size("near")).cast("int")
    place = hash_place(F.concat_ws("/", F.col("id").cast("string"), F.col("_copy").cast("string")), seed) / PLACES
    made = made.select("group", "features", F.col("near")[pick]["donor_id"].alias("_d"), place.alias("_u"))
    ends = points.select(F.col("group"), F.col("id").alias("_d"), F.col("features").alias("_f"))
    between = made.join(ends, ["group", "_d"]).select(
        F.col("group").alias(target), *[(F.col("features")[i] + F.col("_u") * (F.col("_f")[i] - F.col("features")[i])).alias(c)
                                        for i, c in enumerate(columns)], F.lit(1).alias("synthetic"))
    return real.unionByName(between)


def scaled_features(train: DataFrame, columns: Sequence[str], scaler: str) -> Column:
    if scaler == "none":
        return feature_array(columns)
    return F.array(*[(quoted(t.column).cast("double") - t.centre) / t.scale for t in fit_linear(train, columns, scaler)])


def _votes(train: DataFrame, test: DataFrame, id_col: str, columns: Sequence[str], target: str, k: int, scaler: str,
           weights: str, p: int) -> DataFrame:
    """(query_id, target, weight) of every neighbour."""
    if weights not in ("uniform", "distance"):
        raise ValueError(f"unknown weights {weights}")
    features = scaled_features(train, columns, scaler)
    near = knn_join(one_group(test, id_col, features), one_group(train, id_col, features), k, p=p)
    labels = train.select(quoted(id_col).alias("donor_id"), quoted(target).alias("_y"))
    voted = near.join(labels, "donor_id")
    if weights == "uniform":
        return voted.select("query_id", "_y", F.lit(1.0).alias("_w"))
    exact = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy("query_id"))  # k rows each
    return voted.withColumn("_e", exact).select("query_id", "_y", F.when(
        F.col("_e") == 1, (F.col("distance") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), "distance")).alias("_w"))


def knn_classify(train: DataFrame, test: DataFrame, id_col: str, columns: Sequence[str], target: str, k: int = 5,
                 scaler: str = "standard", weights: str = "uniform", p: int = 2) -> DataFrame:
    """Add ``prediction``: the class most neighbours have, the smallest among ties; null for rows with a null feature."""
    votes = _votes(train, test, id_col, columns, target, k, scaler, weights, p)
    counted = votes.groupBy("query_id", "_y").agg(F.round(F.sum("_w"), 9).alias("_s"))
    best = counted.groupBy("query_id").agg(F.min(F.struct((-F.col("_s")).alias("s"), F.col("_y").alias("y"))).alias("b"))
    return test.join(best.select(F.col("query_id").alias(id_col), F.col("b.y").alias("prediction")), id_col, "left")


def knn_regress(train: DataFrame, test: DataFrame, id_col: str, columns: Sequence[str], target: str, k: int = 3,
                scaler: str = "standard", weights: str = "uniform", p: int = 2) -> DataFrame:
    """Add ``prediction``: the (weighted) mean of the neighbours; null for rows with a null feature."""
    votes = _votes(train, test, id_col, columns, target, k, scaler, weights, p)
    mean = votes.groupBy("query_id").agg((F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")).alias("prediction"))
    return test.join(mean.withColumnRenamed("query_id", id_col), id_col, "left")
