import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tabwright.llm import decontamination
from tabwright.llm.decontamination import (FMIndex, Phrases, contamination_digest, find_contamination, find_phrases, merged,
                                           op4_decontamination)


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, width=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1)):
            if w:
                windows.setdefault(tuple(w[i:i + width]), set()).add(item)
    lengths = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[i:i + n])):
                    hit.update(range(i, i + n))
                    found |= owners
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)


def test_index_counts_and_locates():
    rng = np.random.default_rng(4)
    for sigma, n in ((3, 200), (9, 500), (2, 40), (70, 300)):
        text = np.append(rng.integers(1, sigma, n), 0)
        index = FMIndex(text, sigma, every=5)
        for length in (1, 2, 4):
            patterns = np.array([text[a:a + length] for a in rng.integers(0, n - length, 30)] + [[sigma - 1] * length])
            low, high = index.search(patterns)
            for p, a, b in zip(patterns, low, high):
                want = [i for i in range(n + 1 - length) if (text[i:i + length] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_random_texts_match_brute_force():
    rng = random.Random(8)
    vocabulary = ["a", "b", "c", "dd", "é"]
    for _ in range(30):
        items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 9)))) for i in range(6)]
        docs = [" ".join(rng.choices([*vocabulary, "other"], k=rng.randint(0, 60))) for _ in range(10)]
        phrases = Phrases([(i, t.encode()) for i, t in items], 4)
        spans, found = find_phrases([decontamination.words_of(d.encode()) for d in docs], phrases)
        want = {w[0]: w for w in brute(list(enumerate(docs)), items, 4)}
        for i in range(10):
            assert int(np.diff(spans[i]).sum()) == want[i][2] and len(found[i]) == want[i][3]


def test_merged():
    assert merged(np.array([[5, 7], [0, 2], [2, 4], [6, 9], [6, 7]])).tolist() == [[0, 4], [5, 9]]


def test_query_matches_brute_force(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert rows(op4_decontamination(spark, small)) == brute(docs, items)


def test_odd_rows_and_blocks(spark, make_docs, monkeypatch):
    phrase = "one two three four five six seven eight nine ten eleven"
    docs = [(1, None), (2, ""), (3, "x " * 50_000 + phrase.upper()), (4, "one-two, three"), (4, phrase), (None, phrase)]
    items = [(10, phrase), (9, phrase), (11, None), (12, ""), (13, "x"), (13, "two three"), (2, "... !")]
    bench = spark.createDataFrame([*items, (None, "one")], "item_id long, text string").withColumn("n_words", F.lit("clash"))
    df = make_docs(docs).withColumn("items", F.lit("clash"))
    assert rows(contamination_digest(find_contamination(df, bench))) == brute(docs, items)
    whole = decontamination.benchmark_blocks
    monkeypatch.setattr(decontamination, "benchmark_blocks", lambda b: whole(b, 20))
    assert rows(contamination_digest(find_contamination(df, bench))) == brute(docs, items)
    monkeypatch.undo()
    assert rows(contamination_digest(find_contamination(df, bench.limit(0)))) == brute(docs, [])
    assert rows(contamination_digest(find_contamination(df.limit(0), bench))) == []


def test_pipeline_judges_each_row_by_its_text(spark, small, make_docs):
    import corpus_pipeline
    passage = next(r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect() if len(r.text.split()) >= 12)
    docs = make_docs([(None, passage), (None, "clean"), (7, passage), (7, "clean too"), (8, None)])
    left = corpus_pipeline.decontamination(spark, docs, small)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in left.collect()) == [(-1, "clean"), (7, "clean too"), (8, "")]


def test_pipeline_with_many_blocks(spark, make_docs, monkeypatch):
    from tabwright.llm.decontamination import clean_documents
    phrase = "one two three four five six seven eight nine ten eleven"
    items = [(i, f"{phrase} {i}x") for i in range(40)] + [(99, "z")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(i, f"before {phrase} {i}x after") for i in range(0, 60, 7)] + [(100, None), (101, ""), (101, "clean"), (None, "Z z"),
                                                                         (102, "z" * 40), (103, f"{phrase} z {phrase}")] + [(8, "z y")] * 3
    df = make_docs(docs)
    whole = decontamination.benchmark_blocks
    live = []

    def few(b):
        for block in whole(b, 300):
            live.append(len(block))
            yield block
    monkeypatch.setattr(decontamination, "benchmark_blocks", few)
    found = find_contamination(df, bench)
    assert len(live) > 3 and rows(contamination_digest(found)) == brute(docs, items)
    kept = clean_documents(df, bench)
    assert kept.columns == df.columns
    want = [d for d, b in zip(docs, [brute([d], items)[0] for d in docs]) if not b[5]]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
