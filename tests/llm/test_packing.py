import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabwright.llm.packing import Packer, WordIds, best_fill, fill_windows, op10_packing, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_best_fill_matches_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        counts = {rng.randint(1, 40): rng.randint(1, 4) for _ in range(rng.randint(0, 6))}
        room = rng.randint(0, 90)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        chosen = best_fill(counts, room)
        assert all(0 < c <= counts[n] for n, c in chosen.items())
        assert sum(n * c for n, c in chosen.items()) == max(s for s in sums if s <= room)


def test_fill_windows_uses_each_length_once():
    lengths = [random.Random(1).randint(1, 63) for _ in range(500)] + [32] * 40
    windows, failed = fill_windows(lengths, 64)
    used = Counter(failed)
    for chosen, times in windows:
        assert sum(n * c for n, c in chosen.items()) == 64
        for n, c in chosen.items():
            used[n] += c * times
    assert +used == Counter(lengths)


def check(rows, documents, capacity):
    tok = Tokenizer.from_file(PATH)
    want = Counter()
    by_doc = defaultdict(list)
    ids = {d: tok.encode(t or "", add_special_tokens=False).ids + [2] for d, t in documents}
    for r in rows:
        part = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        by_doc[r.doc_id].append((r.start, r.length))
    for d, parts in by_doc.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[d])
    assert set(by_doc) == set(ids)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == capacity or at < capacity and at & (at - 1) == 0
    return want


def test_query_covers_every_id(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    check(op10_packing(spark, small).collect(), [(r.doc_id, r.text) for r in docs.collect()], 4096)


def test_odd_rows(spark, make_docs):
    items = [(1, None), (2, ""), (3, "word " * 30_000), (4, "a b\x1cc don't İ Σς 日本 <|endoftext|> x"), (5, "é\x85ü\xa0²½ ''s")]
    docs = make_docs(items).withColumn("start", F.lit("x")).withColumn("offset", F.lit(None).cast("string"))
    check(pack(docs, PATH, 2, capacity=64, group=500).collect(), items, 64)
    repeated = make_docs([(7, "one two"), (7, "one two"), (None, "three")])
    assert sorted((r.doc_id or -1, r.doc_tokens) for r in pack(repeated, PATH, 2).where("start = 0").collect()) == [
        (-1, 2), (7, 3), (7, 3)]
    assert pack(make_docs([]), PATH, 2).collect() == []


def test_words_match_tokenizer():
    tok, words = Tokenizer.from_file(PATH), WordIds(PATH, most=50)
    rng = random.Random(3)
    alphabet = "abcDEé ß'\"s\t\n\x1c\x85\xa0²1.,-µÀ×÷"
    batch = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(400)]
    for _ in range(2):
        for text, ids in zip(batch, words.encode(batch)):
            assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids


def test_little_padding_needs_no_cut_when_lengths_fit():
    packer = Packer(8, 1_000, 0)
    for i, n in enumerate([5, 3, 6, 2, 4, 4]):
        packer.put(i, np.arange(n, dtype="<u4"))
    packer.flush(True)
    assert len(packer.rows) == 6 and packer.next_id == 3
    assert pytest.approx(0) == sum(r[1] for r in packer.rows)
