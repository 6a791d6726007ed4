import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabwright.llm.token_counts import (TokenMachine, Transitions, batch_counts, character_classes, count_tokens,
                                        op9_token_counts, pretoken_starts, token_machine)

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)


def counts(items):
    return batch_counts(items, token_machine(PATH), np.frombuffer(character_classes(PATH), np.uint8)).tolist()


def want(items):
    return [len(e.ids) for e in TOK.encode_batch(items, add_special_tokens=False)]


def test_random_text_matches_tokenizer():
    rng = random.Random(2)
    alphabets = ["ab'sretvlmd ", "  \n\t'x1.!", "theinganditos .,", "éüßñ日本語кот😀e\u0301 ", "%&#=_-09af\\/"]
    items = ["".join(rng.choices(rng.choice(alphabets), k=rng.randint(0, 400))) for _ in range(1_500)]
    assert counts(items) == want(items)


def test_edges():
    items = ["", " ", "   ", "'", "'r", "'re", "''re", " 're", "'ll'l", "don't've", "a  b", "a \nb", "\n\n b", "a\u00a0\u3000b ",
             "<|endoftext|>", "x<|endoftext|> y<|endoftext|><|endoftext|>z ", "1½²3 x٣", "x" * 5_000, " " * 3_000, "=" * 999]
    assert counts(items) == want(items)


def test_chunk_length_does_not_matter():
    rng = np.random.default_rng(1)
    kinds = rng.integers(0, 12, 5_000).astype(np.uint8)
    whole = pretoken_starts(kinds, 5_000)
    for chunk in (1, 7, 64, 256):
        assert (pretoken_starts(kinds, chunk) == whole).all()


def test_long_pretokens_by_chunk_maps():
    rng = random.Random(5)
    items = ["a" * 30_001, "ab" * 9_000, "the" * 7_000, "".join(rng.choices("theinganditos", k=20_000)), "=" * 12_345, " " * 10_000,
             "é" * 5_000, "".join(rng.choices("日本語", k=4_000)), "".join(rng.choices("ACGT", k=15_000)), "word"]
    assert counts(items) == want(items)
    small, classes = TokenMachine(PATH, most=500, chunk=7), np.frombuffer(character_classes(PATH), np.uint8)
    for _ in range(2):  # the second time after the states were forgotten
        assert batch_counts([i[:900] for i in items], small, classes).tolist() == want([i[:900] for i in items])


def test_transitions():
    table, rng = Transitions(6), random.Random(1)
    pairs = {rng.randrange(1 << 40): i for i in range(400)}
    for key, value in pairs.items():
        table.add([key], [value])
        if table.full():
            table.widen()
    keys = np.array([*pairs, *(k + 1 for k in pairs)], np.int64)
    assert table.find(keys).tolist() == [pairs.get(k, -1) for k in keys.tolist()] and table.mask > 63


def test_query_matches_tokenizer(spark, small):
    rows = {r.doc_id: r for r in op9_token_counts(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d, n in zip(docs, want([d.text for d in docs])):
        r = rows[d.doc_id]
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(d.text.encode()), n > 512)


def test_odd_rows(spark, make_docs):
    docs = make_docs([(1, None), (2, ""), (None, "a b"), (3, "x y"), (3, "x y"), (4, "long word " * 20_000)])
    docs = docs.withColumn("n_tokens", F.lit("clash"))
    got = sorted(((r.doc_id or -1), r.n_bytes, r.n_tokens) for r in count_tokens(docs, PATH).collect())
    assert got == [(-1, 3, 2), (1, 0, 0), (2, 0, 0), (3, 3, 2), (3, 3, 2), (4, 200_000, want(["long word " * 20_000])[0])]
    assert count_tokens(make_docs([]), PATH).collect() == []
