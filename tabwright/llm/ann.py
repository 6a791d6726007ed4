"""Approximate nearest neighbours with learned partitions.

A bounded sample of the vectors gives a nearest-neighbour graph. The graph is cut into parts of equal size with few edges
between them: recursive bisection along the second eigenvector, then exchanges of equally many vertices while they lower
the cut. A small network learns which parts the neighbours of a vector lie in; it assigns every row of the table to its
most probable part and sends a query to its several most probable ones, where candidates are ranked by exact cosine.

Rows with the same vector are indexed as one entry with their smallest ids: no more than those can be among the nearest.
Vectors of different length never meet: the most frequent lengths have a router each, vectors of any other length meet all
others of their length.
Parts and their queries meet in blocks of bounded size, so neither a large part nor a popular one lands in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tabwright.llm.common import columns_of, table, written
from tabwright.llm.registry import query

LENGTHS = 4  # vector lengths with a router of their own
RARE = 1_024  # parts that vectors of other lengths are spread over
PART_BITS = 20  # a part's number within its length


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at length 1, scaled by their largest entry first so that no square overflows or vanishes."""
    v = np.asarray(vectors, np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def neighbour_lists(vectors: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row (rows of length 1)."""
    out = []
    for start in range(0, len(vectors), 1_000):
        near = vectors[start:start + 1_000] @ vectors.T
        near[np.arange(len(near)), start + np.arange(len(near))] = -np.inf
        out.append(np.argpartition(-near, min(k, near.shape[1] - 1), 1)[:, :k])
    return np.concatenate(out)


def bisect(graph: np.ndarray, rng: np.random.Generator, rounds: int = 60) -> np.ndarray:
    """Side (0 or 1) of each vertex of a dense symmetric graph; sides differ by one vertex at most."""
    n = len(graph)
    degree = np.maximum(graph.sum(1), 1e-9)
    root = np.sqrt(degree)
    walk = graph / root[:, None] / root[None, :]
    x, top = rng.standard_normal(n).astype(graph.dtype), root / np.linalg.norm(root)
    for _ in range(rounds):  # power iteration away from the first eigenvector, on a positive spectrum
        x -= top * (top @ x)
        x = walk @ x + x
        x /= max(np.linalg.norm(x), 1e-12)
    side = np.zeros(n, np.int8)
    side[np.argsort(x / root, kind="stable")[n // 2:]] = 1
    for _ in range(20):
        other = graph @ (side == 1) - graph @ (side == 0)
        gain = np.where(side == 0, other, -other)  # lowers the cut by this when moved
        a, b = (np.flatnonzero(side == s) for s in (0, 1))
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        m = min(len(a), len(b))
        better = int((gain[a[:m]] + gain[b[:m]] > 0).sum()) // 2
        if not better:
            break
        trial = side.copy()
        trial[a[:better]], trial[b[:better]] = 1, 0
        if trial @ graph @ (1 - trial) >= side @ graph @ (1 - side):
            break
        side = trial
    return side


def balanced_parts(near: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """Part of each vertex; ``parts`` is a power of two."""
    n = len(near)
    graph = np.zeros((n, n), np.float32)
    graph[np.repeat(np.arange(n), near.shape[1]), near.ravel()] = 1
    graph = np.maximum(graph, graph.T)
    part, rng, count = np.zeros(n, np.int64), np.random.default_rng(seed), 1
    while count < parts:
        halves = np.zeros(n, np.int64)
        for p in range(count):
            members = np.flatnonzero(part == p)
            halves[members] = bisect(graph[np.ix_(members, members)], rng) if len(members) > 1 else 0
        part, count = 2 * part + halves, 2 * count
    return part


class Router:
    """One hidden layer from a vector to the probabilities of the parts."""

    def __init__(self, vectors: np.ndarray, targets: np.ndarray, hidden: int = 128, epochs: int = 40, seed: int = 3):
        rng = np.random.default_rng(seed)
        d, m = vectors.shape[1], targets.shape[1]
        w = [rng.standard_normal((d, hidden)) * np.sqrt(2), np.zeros(hidden), rng.standard_normal((hidden, m)) / np.sqrt(hidden),
             np.zeros(m)]
        mean, square, step = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(vectors)), max(1, len(vectors) // 64)):
                x, y = vectors[at], targets[at]
                h = np.maximum(x @ w[0] + w[1], 0)
                error = (self._softmax(h @ w[2] + w[3]) - y) / len(at)
                back = (error @ w[2].T) * (h > 0)
                step += 1
                for i, g in enumerate((x.T @ back, back.sum(0), h.T @ error, error.sum(0))):  # Adam
                    mean[i] += 0.1 * (g - mean[i])
                    square[i] += 0.001 * (g * g - square[i])
                    w[i] -= 0.003 * (mean[i] / (1 - 0.9 ** step)) / (np.sqrt(square[i] / (1 - 0.999 ** step)) + 1e-8)
        self.w = w

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        return self._softmax(np.maximum(vectors @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3])


def learn_parts(sample: np.ndarray, parts: int, neighbours: int = 10) -> Router:
    """The router trained on a sample of unit vectors."""
    near = neighbour_lists(sample, min(neighbours, len(sample) - 1))
    part = balanced_parts(near, parts)
    targets = np.zeros((len(sample), parts))
    np.add.at(targets, (np.repeat(np.arange(len(sample)), near.shape[1] + 1),
                        part[np.concatenate([near, np.arange(len(sample))[:, None]], 1)].ravel()), 1)
    return Router(sample, targets / targets.sum(1, keepdims=True))


def usable_vectors(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows whose vector takes part: not null or empty, all entries finite, not all zero."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embeddings.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(~bad).where(F.exists(v, lambda x: x != 0.0))


def nearest(embeddings: DataFrame, queries: DataFrame, k: int = 5, parts: int = 32, probes: int = 26,
            sample: int = 4_096, block: int = 4_096, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row of ``queries``, its own id left out.

    Both tables have ``key`` and ``vector``. ``parts`` (a power of two) and ``probes`` set the index and how many parts a
    query visits; the graph and the router come from at most ``sample`` distinct vectors, those of smallest hash; every row
    is indexed. Each of the ``LENGTHS`` most frequent vector lengths has its own index. ``block`` bounds the rows that meet in
    one task. Rows that cannot take part are left out. Ties go to the smaller id. An id on several rows is found once, by its
    nearest vector; as a query it asks with the smallest of its vectors.
    """
    rows = usable_vectors(embeddings, key, vector)
    # one entry per vector: k + 1 ids suffice, since a query leaves out at most its own
    order = Window.partitionBy("v").orderBy("vec_id")
    ids = rows.dropDuplicates(["vec_id", "v"]).withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k + 1)
    entries = written(ids.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")), "ann-entries")
    asked = usable_vectors(queries, key, vector).groupBy("vec_id").agg(F.min("v").alias("v"))
    common = entries.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").limit(LENGTHS).collect()
    routers: dict[int, tuple[Router | None, int]] = {}  # and the number of parts
    for width in (r.width for r in common):
        chosen = entries.where(F.size("v") == width).select("v").withColumn("h", F.xxhash64("v")).orderBy("h", "v").limit(sample)
        kept, cuts = unit(np.array([r.v for r in chosen.select("v").collect()])), parts
        while cuts > 1 and len(kept) < 4 * cuts:
            cuts //= 2
        routers[width] = learn_parts(kept, cuts) if len(kept) > 1 and cuts > 1 else None, cuts

    def visits_of(vectors: list, visits: int | None) -> list[list[int]]:
        """Parts of each vector, its most probable one or the first ``visits``."""
        lengths = np.array([len(v) for v in vectors])
        out: list[list[int]] = [[-1 - int(n) % RARE] for n in lengths]
        for n in set(lengths.tolist()) & set(routers):
            at, (router, cuts) = np.flatnonzero(lengths == n), routers[n]
            v = unit(np.array([vectors[i] for i in at], np.float64))
            best = np.argsort(-router(v), 1, kind="stable")[:, :visits] if router else np.zeros((len(v), 1), np.int64)
            for i, row in zip(at, best):
                out[i] = ((n << PART_BITS) + row).tolist()
        return out

    def routed(names: list[str], visits: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                best = visits_of(columns_of(batch, "v")[0], visits)
                columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(best, pa.list_(pa.int64()))], names=[*names, "part"])
        return run
    indexed = entries.mapInArrow(routed(["ids", "v"], 1), "ids array<long>, v array<double>, part array<long>")
    indexed = written(indexed.select("ids", "v", F.col("part")[0].alias("part")), "ann-index")
    sent = asked.mapInArrow(routed(["vec_id", "v"], probes), "vec_id long, v array<double>, part array<long>")
    sent = written(sent.select("vec_id", "v", F.explode("part").alias("part")), "ann-queries")

    def blocks_of(df: DataFrame) -> dict[int, int]:
        return {r.part: -(-r.n // block) for r in df.groupBy("part").agg(F.count("*").alias("n")).collect()}
    index_blocks, query_blocks = blocks_of(indexed), blocks_of(sent)

    def number(blocks: dict[int, int]):
        return F.coalesce(F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair])[F.col("part")], F.lit(0)) if blocks else F.lit(0)

    def dealt(df: DataFrame, own: dict[int, int], other: dict[int, int], mine: str, theirs: str, salt) -> DataFrame:
        n = number(other).cast("int")
        return df.withColumn(mine, F.pmod(F.xxhash64(salt), F.greatest(number(own), F.lit(1))).cast("int")).where(n > 0).withColumn(
            theirs, F.explode(F.sequence(F.lit(0), n - 1)))
    left = dealt(sent, query_blocks, index_blocks, "qb", "ib", F.col("vec_id"))
    right = dealt(indexed, index_blocks, query_blocks, "ib", "qb", F.col("v"))

    def rank(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        ids, out = [np.asarray(x) for x in c.ids], []
        of_query, of_entry = q.v.map(len).to_numpy(int), c.v.map(len).to_numpy(int)
        for n in set(of_query.tolist()) & set(of_entry.tolist()):
            asks, at = np.flatnonzero(of_query == n), np.flatnonzero(of_entry == n)
            qv, cv = (unit(np.stack(x.v.iloc[rows].to_numpy())) for x, rows in ((q, asks), (c, at)))
            for start in range(0, len(qv), 256):
                for i, row in enumerate(qv[start:start + 256] @ cv.T):
                    own, take, best = q.vec_id.iat[asks[start + i]], k + 1, {}
                    while True:  # entries that may be among the nearest, more of them where ids repeat
                        take = min(take, len(row))
                        may = np.flatnonzero(row >= np.partition(row, -take)[-take] - 1e-12)  # with room for rounding
                        exact = (cv[may] * qv[start + i]).sum(1)
                        best = {}
                        for s, j in zip(exact.tolist(), may.tolist()):
                            for x in ids[at[j]].tolist():
                                if x != own and s > best.get(x, -np.inf):
                                    best[x] = s
                        if len(best) >= k or take == len(row):
                            break
                        take *= 4
                    out += [(own, x, -s) for s, x in sorted((-s, x) for x, s in best.items())[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    on = ["part", "qb", "ib"]
    found = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(rank, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).selectExpr(
        "query_id", "rank", "vec_id", "score")


@query("op6_ann")
def op6_ann(spark, folder):
    embeddings = table(spark, folder, "embeddings")
    return nearest(embeddings, embeddings.where(F.col("vec_id") % 50 == 0))
