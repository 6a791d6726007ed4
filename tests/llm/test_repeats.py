import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from tabwright.llm.repeats import (Hashes, Powers, find_repeats, longest_previous_factors, op8_repeats, remove_repeats,
                                   repeated_windows, sliding)


def brute(items, length=100):
    seen, out = set(), []
    for d, text in sorted(items, key=lambda x: x[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            w = data[i:i + length]
            if w in seen:
                gone[i:i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not p for p, g in zip(b"\0" + bytes(gone), gone))
        out.append((d, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def result(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_longest_previous_factors():
    rng = random.Random(1)
    for _ in range(50):
        text = "".join(rng.choices("ab", k=rng.randint(1, 25)))
        order = np.array(sorted(range(len(text)), key=lambda i: text[i:]))
        def shared(i, j):
            n = 0
            while i + n < len(text) and j + n < len(text) and text[i + n] == text[j + n]:
                n += 1
            return n
        common = np.array([0] + [shared(a, b) for a, b in zip(order, order[1:])])
        got = longest_previous_factors(order, np.arange(len(text)), common)
        assert got.tolist() == [max([shared(i, j) for j in range(i)], default=0) for i in range(len(text))]


def test_helpers():
    data = np.frombuffer(b"abcabcabd" * 3, np.uint8)
    h = Hashes(data, Powers(), 0)
    assert h.of(np.array([0]), np.array([3])) == h.of(np.array([3]), np.array([6])) != h.of(np.array([6]), np.array([9]))
    values = np.random.default_rng(1).integers(0, 99, 50)
    for w in (1, 2, 7, 16, 50):
        assert sliding(values, w).tolist() == [values[i:i + w].min() for i in range(51 - w)]
    content = np.frombuffer(b"abcabdabcabc", np.uint8).reshape(4, 3)
    assert repeated_windows(content, np.array([2, 1, 1, 1]), np.array([0, 0, 5, 3])).tolist() == [True, False, True, False]


def documents():
    rng = random.Random(9)
    def words(n):
        return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "é", "omega"]) + str(rng.randrange(300)) for _ in range(n))
    passage, line = words(40), words(15)[:103]
    texts = [words(rng.randint(1, 200)) for _ in range(40)]
    texts += [f"{words(rng.randint(0, 30))} {passage} {words(rng.randint(0, 30))}" for _ in range(25)]
    texts += [f"{words(5)}{line}{words(5)}" for _ in range(25)]
    texts += [f"{words(5)}{line[:99]}{words(5)}" for _ in range(15)]
    for _ in range(15):
        t = rng.choice(texts)
        at = rng.randrange(len(t) + 1)
        texts.append(t[:at] + "#" + t[at + 1:])
    texts += texts[:10] + ["=" * 1_500, "-" * 99, "-" * 100, "-" * 101, "ab" * 400, *[words(n) * 3 for n in range(1, 16)], (words(4) + "x") * 4 + words(9), "=" * 700, words(30) * 3, "", None]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_documents_match_brute_force(spark, make_docs):
    items = documents()
    want = brute(items)
    docs = make_docs(items)
    assert result(remove_repeats(docs)) == want
    assert sum(w[2] for w in want) > 10_000
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    found = {(r.doc_id, r.start + i) for r in find_repeats(rows, most_spans=3).collect() for i in range(r.n)}
    assert found == {(r.doc_id, r.start + i) for r in find_repeats(rows).collect() for i in range(r.n)}


def test_query_matches_brute_force(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert result(op8_repeats(spark, small)) == brute(docs)


def test_odd_rows(spark, make_docs):
    long = " ".join(map(str, range(30_000)))
    a, b = "first " * 30, "second " * 30
    docs = make_docs([(1, long), (2, long + "!"), (3, None), (4, ""), (None, long), (5, a), (5, a), (5, b)])
    got = [r[:4] for r in sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeats(
        docs.withColumn("start", F.lit("clash"))).collect())]
    n = len(long)
    five = sorted((5, *r[1:4]) for r in brute([(5, a)]))[0]
    other = sorted((5, *r[1:4]) for r in brute([(5, b)]))[0]
    assert got[:5] == [(-1, n, 0, 0), (1, n, 0, 0), (2, n + 1, n, 1), (3, 0, 0, 0), (4, 0, 0, 0)]
    assert got[5:] in (sorted([five, five, (5, len(b), 0, 0)]), sorted([(5, len(a), 0, 0)] * 2 + [other]))
    assert remove_repeats(make_docs([])).collect() == []
