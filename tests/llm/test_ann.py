import numpy as np
from pyspark.sql import functions as F, types as T

from tabwright.llm.ann import balanced_parts, bisect, nearest, neighbour_lists, op6_ann, unit

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("score", T.StringType())])


def brute(rows, k, step=50):
    ids, v = np.array([r[0] for r in rows]), unit(np.array([r[1] for r in rows], np.float32))
    out = {}
    for i in np.flatnonzero(ids % step == 0):
        s = (v * v[i]).sum(1)
        others = np.flatnonzero(ids != ids[i])
        best = others[np.lexsort((ids[others], -s[others]))[:k]]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in best]
    return out


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_bisection_finds_two_groups():
    rng = np.random.default_rng(1)
    v = unit(rng.standard_normal((60, 5)) + np.repeat([[6, 0, 0, 0, 0], [0, 6, 0, 0, 0]], 30, 0))
    graph = np.zeros((60, 60), np.float32)
    near = neighbour_lists(v, 5)
    graph[np.repeat(np.arange(60), 5), near.ravel()] = 1
    side = bisect(np.maximum(graph, graph.T), rng)
    assert side[:30].std() == 0 and side[30:].std() == 0 and side[0] != side[-1]
    assert np.bincount(balanced_parts(near, 4)).tolist() == [15] * 4


def test_recall_and_scores(spark, small):
    folder = small.replace("0.001", "0.1")
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want, got = brute(rows, 5), by_query(op6_ann(spark, folder))
    assert set(want) == set(got) and all(len(x) == 5 for x in got.values())
    hits = sum(len({a for a, _ in want[q]} & {a for a, _ in got[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    exact = {q: dict(x) for q, x in brute(rows, len(rows)).items()}
    assert all(abs(exact[q][a] - s) < 1e-12 for q, x in got.items() for a, s in x)


def test_copies_ties_and_unusable_rows(spark):
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(400)] + [(1000 + i, [float(i), 1.0, -1.0]) for i in range(20)]
    odd = [(2000, None), (2050, [0.0, 0.0, 0.0]), (2100, [1.0, float("nan"), 0.0]), (2150, [1.0, None, 0.0]),
           (2200, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (0, [1.0, 2.0, 0.5]), (2250, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], SCHEMA).repartition(5)
    got = by_query(nearest(df, df.where(F.col("vec_id") % 50 == 0), parts=1, block=7))
    want = brute(rows, 5)
    assert {q: [a for a, _ in x] for q, x in got.items()} == {q: [a for a, _ in x] for q, x in want.items()}


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], "x"), (1, [0.0, 1.0], "x")], SCHEMA)
    assert by_query(nearest(df, df.where("vec_id = 0"))) == {0: [(1, 0.0)]}
    assert nearest(df.limit(0), df).collect() == [] and nearest(df, df.limit(0)).collect() == []


def test_lengths_apart_and_repeated_ids(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(2 + i % 6).tolist()) for i in range(180)]  # six lengths, four of them with a router
    rows += [(1, [3.0 + i / 50, 1.0]) for i in range(40)] + [(50, [9.0, -1.0, 2.0, 0.5]), (50, [-9.0, 1.0, 2.0, 0.5])]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(4)
    got = by_query(nearest(df, df.where(F.col("vec_id") % 10 == 0), parts=1, block=50))
    want = {}
    for q in {r[0] for r in rows if r[0] % 10 == 0}:
        mine = min(np.array(v, np.float32).tolist() for i, v in rows if i == q)
        a, best = unit(np.array([mine], np.float32))[0], {}
        for i, v in rows:
            if i != q and len(v) == len(mine):
                best[i] = max(best.get(i, -2.0), float((unit(np.array([v], np.float32))[0] * a).sum()))
        want[q] = sorted(best, key=lambda i: (-best[i], i))[:5]
    assert {q: [a for a, _ in x] for q, x in got.items()} == want
