import random

import numpy as np
from pyspark.sql import functions as F

from tabwright.llm import near_dedup
from tabwright.llm.components import connected_components
from tabwright.llm.near_dedup import (BUCKETS, WordHashes, chance_agreement, estimates, near_duplicates, op1_near_dedup,
                                      registers, shingles)


def brute(items):
    """(doc_id, set size, component, kept) by comparing all pairs that share a shingle."""
    def cut(text):
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    sets, parent, holders = [cut(t) for _, t in items], list(range(len(items))), {}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, s in enumerate(sets):
        near = {}
        for x in s:
            for j in holders.setdefault(x, []):
                near[j] = near.get(j, 0) + 1
            holders[x].append(i)
        for j, n in near.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(items):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(items))


def result(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def family(rng, n, words, edits):
    base = [f"w{rng.randrange(5_000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(words)] = f"x{rng.randrange(5_000)}"
        out.append(" ".join(copy))
    return out


def test_estimate_follows_similarity():
    rng, known = np.random.default_rng(1), WordHashes()
    got = []
    for _ in range(40):
        shared, own = rng.integers(0, 2**63, 3_000, np.uint64), rng.integers(0, 2**63, (2, 500), np.uint64)
        a, b = (np.unique(np.concatenate([shared, o]) * np.uint64(2)) for o in own)
        got.append(estimates(registers(a)[None], registers(b)[None], chance_agreement(np.array([len(a)]), np.array([len(b)])))[0][0])
    assert abs(np.mean(got) - 0.75) < 0.02
    far = [registers(np.unique(rng.integers(0, 2**64 - 1, 4_000, np.uint64))) for _ in range(200)]
    agree = np.mean([(far[i] == far[i + 1]).mean() for i in range(199)])
    assert agree < 3 * chance_agreement(np.array([4_000]), np.array([4_000]))[0] + 2 / BUCKETS / 199
    assert len(shingles(b"A b  c\td\x0be f", known)) == 2 and len(shingles(b"a B", known)) == 1


def test_components(spark):
    rng = random.Random(6)
    for edges in ([(i, i + 1) for i in range(40)], [(rng.randrange(60), rng.randrange(60)) for _ in range(45)], [(5, 5)], []):
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        parent = {}
        def root(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x
        for a, b in edges:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
        assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_families_match_brute_force(spark, make_docs, monkeypatch):
    rng = random.Random(4)
    items = []
    for words, edits, n in ((60, 3, 25), (200, 12, 40), (120, 5, 30), (30, 1, 12), (6, 1, 8), (400, 60, 10)):
        items += family(rng, n, words, edits)
    items += [items[0]] * 5 + ["", None, " \n", "one", "One", "two words"]
    order = list(range(len(items)))
    rng.shuffle(order)
    docs = list(zip(order, items))
    want = brute(docs)
    assert result(near_duplicates(make_docs(docs))) == want
    assert result(near_duplicates(make_docs(docs), block=7)) == want


def test_query_matches_brute_force(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert result(op1_near_dedup(spark, small)) == brute(docs)


def test_odd_rows(spark, make_docs):
    long = " ".join(map(str, range(40_000)))
    docs = make_docs([(5, long), (9, long + " end"), (3, None), (4, ""), (7, "a b c d e f"), (7, "a b c d e f"), (8, "g h i j k l"),
                      (8, "a b c d e f")]).withColumn("component_id", F.lit("clash"))
    assert result(near_duplicates(docs)) == [
        (3, 0, 3, True), (4, 0, 4, True), (5, 39_996, 5, True), (7, 2, 7, True), (7, 2, 7, True), (8, 2, 7, False),
        (8, 2, 7, False), (9, 39_997, 5, False)]
    nameless = near_duplicates(make_docs([(None, "a b c d e"), (None, "a b c d e"), (1, "a b c d e")])).collect()
    assert all(r.kept for r in nameless) and len(nameless) == 3
    assert near_duplicates(make_docs([])).collect() == [] and near_dedup.ROWS == 4
