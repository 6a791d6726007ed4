import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from tabwright.llm.ranking import Best, Tile, item_blocks, ranked_documents, tile_scores

ITEM = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("text", T.StringType())])


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)


def brute(docs, items, k):
    lists = [(i, Counter(words(t))) for i, t in docs]
    lists = [(i, c, sum(c.values())) for i, c in lists if c]
    total, length = len(lists), sum(n for *_, n in lists)
    holders = Counter(t for _, c, _ in lists for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(words(text))
    out = []
    for item, terms in wanted.items():
        scores = []
        for doc, c, n in lists:
            m = 100 - 50 + 50 * n * total // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * holders[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 20 * m))
                        for t in terms if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def some_tables(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "a1", "É", "日本", "x", "y", "zeta", "über", "rare%d", "q-r", "don't"]
    docs = [(rng.choice((i, i, i, 7)), " ".join(w % rng.randint(0, 40) if "%d" in w else w for w in rng.choices(vocabulary, k=rng.randint(0, 25))))
            for i in range(n)]
    items = [(f"i{rng.randint(0, 25)}", " ".join(w % rng.randint(0, 40) if "%d" in w else w for w in rng.choices(vocabulary, k=rng.randint(0, 6))))
             for _ in range(30)]
    return docs + [(None, "the zeta"), (None, "the zeta"), (3, None), (4, "")], items + [(None, "zeta"), ("none", None), ("empty", " .")]


@pytest.mark.parametrize("size", [dict(), dict(block=5, width=3, rows=7), dict(k=3, rows=1)])
def test_ranking_matches_brute_force(spark, make_docs, size):
    docs, items = some_tables(len(size))
    df = make_docs(docs, 4).withColumn("score", F.lit("clash")).withColumn("item_id", F.lit(1))
    found = ranked_documents(df, spark.createDataFrame(items, ITEM).withColumn("rank", F.lit(0)), **size)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items, size.get("k", 50))


def test_empty_tables(spark, make_docs):
    items = spark.createDataFrame([("a", "x")], ITEM)
    assert ranked_documents(make_docs([]), items).collect() == []
    assert ranked_documents(make_docs([None, ""]), items).collect() == []
    assert ranked_documents(make_docs(["x"]), items.limit(0)).collect() == []


def test_long_text(spark, make_docs):
    docs = [(0, "x " * 200_000 + "y"), (1, "y"), (2, "z")]
    items = [("a", "x y")]
    found = ranked_documents(make_docs(docs), spark.createDataFrame(items, ITEM))
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items, 50)


def test_blocks_hold_whole_items(spark):
    items = spark.createDataFrame([("a", "x y z"), ("b", "x"), ("a", "y w"), ("c", "u v"), (None, "k")], ITEM)
    blocks = list(item_blocks(items, 4))
    assert [ids for ids, _ in blocks] == [[None], ["a"], ["b", "c"]]
    assert blocks[1][1] == [[b"w", b"x", b"y", b"z"]]


def test_products_stay_exact():
    """Weights so large that one product more in a slice would pass 2^53; the slices' sums go beyond it."""
    weight = np.full(40, 2 ** 53 // (10 ** 6 * 4) - 1, np.int64)
    tile = Tile([0], [np.arange(40, dtype=np.int32)])
    assert max(len(part) for part, _ in tile.slices(weight, 2_048)) == 4
    impact = np.arange(999_960, 1_000_000)
    found = tile_scores(tile, weight, 2_048, np.arange(40), np.zeros(40, np.int64), impact, 1)
    assert found.tolist() == [[int(weight[0]) * int(impact.sum())]] and found[0, 0] > 2 ** 53


def test_ties_do_not_depend_on_the_order_of_tiles():
    rng = np.random.default_rng(1)
    scores, ids = rng.integers(0, 4, (2, 300)), rng.permutation(300)
    best = Best(2, 20)
    for at in np.array_split(np.arange(300), 17):
        best.add([0, 1], scores[:, at], ids[at])
    for i in range(2):
        order = np.lexsort((ids, -scores[i]))[:20]
        assert best.ids[i].tolist() == ids[order].tolist() and best.scores[i].tolist() == scores[i][order].tolist()
