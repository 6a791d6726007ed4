import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tabwright.llm.runs import LEAST, POWERS, find_runs, fragments, op12_runs, planted, tiles, z_function


def brute_runs(words):
    """(start, period, length) of every run, by comparing all pairs of words at each distance."""
    found = {}
    for p in range(1, len(words) // POWERS + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(LEAST, POWERS * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((a, p, b - a) for (a, b), p in found.items())


def some_lists(n, rng):
    for _ in range(n):
        words = rng.choices("abc"[:rng.choice((1, 2, 2, 3))], k=rng.randint(0, 30))
        for _ in range(rng.randint(0, 4)):
            block = rng.choices("abcdefgh", k=rng.randint(1, 70))
            words += block * rng.randint(1, 7) + block[:rng.randint(0, len(block))] + rng.choices("abxyz", k=rng.randint(0, 30))
        yield words


def solved(lists):
    """The operator's steps on plain lists: tiles, fragments, and a plain stitching."""
    lists = sorted(lists, key=len, reverse=True)
    sizes = np.array([len(x) for x in lists])
    starts = np.cumsum(sizes + 1) - sizes - 1
    words = -np.arange(1, (sizes + 1).sum() + 4 * sizes[0] + 66)
    for x, s in zip(lists, starts):
        words[s:s + len(x)] = [ord(c) for c in x]
    parts = {}
    for d, octave, first, at, begin, end in tiles(words, starts, sizes):
        for b in at.tolist():
            for p, i, j in fragments(words[begin:end].tolist(), b, octave, first, int(sizes[d])):
                parts.setdefault((d, p), []).append((i, j))
    out = [{} for _ in lists]
    for (d, p), spans in sorted(parts.items()):
        whole = []
        for i, j in sorted(spans):
            if whole and i <= whole[-1][1] - p:
                whole[-1][1] = max(whole[-1][1], j)
            else:
                whole.append([i, j])
        for i, j in whole:
            if j - i >= max(LEAST, POWERS * p):
                out[d].setdefault((i, j), p)
    return lists, [sorted((i, p, j - i) for (i, j), p in o.items()) for o in out]


def test_tiles_and_fragments_match_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        lists, got = solved(list(some_lists(8, rng)))
        for words, runs in zip(lists, got):
            assert runs == brute_runs(words), "".join(words)


def test_powers_make_few_tiles():
    """A text of one word has tiles in the first octave alone."""
    n = 5_000
    words = np.concatenate([np.zeros(n, np.int64), -np.arange(1, 4 * n + 100)])
    found = list(tiles(words, np.array([0]), np.array([n])))
    assert {t[1] for t in found} == {0} and len(found) < n / 60


def test_z_function():
    rng = random.Random(1)
    for _ in range(200):
        s = rng.choices((0, 1), k=rng.randint(0, 40))
        assert z_function(s) == [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]


def sha(text):
    return hashlib.sha256(text).hexdigest()


def want(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0 and words:
        g, n, old = zlib.crc32(str(doc_id).encode()) // 10, len(words), list(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        for i in range(a, n):
            words[i] = old[a + (i - a) % p]
    runs = brute_runs(words)
    gone = {i for a, p, n in runs for i in range(a + p, a + n)}
    best = min(((-n, a, p) for a, p, n in runs), default=None)
    lines = "".join(f"{a},{n},{p}\n" for a, p, n in runs)
    return (len(runs), *((best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4), sha(lines.encode()),
            sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_matches_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("length(text) < 6000")
    docs.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/runs/documents.parquet")
    rows = {r.doc_id: tuple(r)[1:] for r in op12_runs(spark, path.rpartition("/")[0]).collect()}
    docs = docs.collect()
    assert len(rows) == len(docs) > 150
    for d in docs:
        assert rows[d.doc_id] == want(d.doc_id, d.text), d.doc_id


def test_odd_rows(spark, make_docs):
    line = "to be or not to be that is the question "
    many = line * 900
    docs = make_docs([(1, None), (2, ""), (3, " \n\t "), (None, "x " * 9), (4, "x " * 5), (4, "x " * 6), (4, "x " * 6), (5, many),
                      (6, "é\u00a0é " * 7), (7, "no run here")]).withColumn("runs", F.lit("clash"))
    rows = find_runs(docs).collect()
    got = sorted((r.doc_id or -1, [tuple(x) for x in r.runs], r.collapsed_sha256) for r in rows)
    assert got == sorted([(1, [], sha(b"")), (2, [], sha(b"")), (3, [], sha(b"")), (-1, [(0, 1, 9)], sha(b"x")),
                          (4, [], sha(b"x x x x x")), (4, [(0, 1, 6)], sha(b"x")), (4, [(0, 1, 6)], sha(b"x")),
                          (5, [(0, 10, 9_000)], sha(line.strip().encode())), (6, [(0, 1, 7)], sha("é\u00a0é".encode())),
                          (7, [], sha(b"no run here"))])
    assert {r.collapsed for r in rows if r.doc_id == 5} == {line.strip()}
    assert find_runs(make_docs([])).collect() == []


def test_planted_repetition_leaves_other_documents():
    assert planted(None, [b"a"]) == [b"a"] and planted(0, []) == []
    changed = [i for i in range(2_000) if planted(i, [b"%d" % k for k in range(50)]) != [b"%d" % k for k in range(50)]]
    assert 100 < len(changed) < 300
