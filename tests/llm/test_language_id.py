import zlib

import numpy as np
from pyspark.sql import functions as F

from tabwright.llm.language_id import Profiles, identify, learn_languages, op5_language_id


def test_bundle_is_bound_permuted_sum():
    p = Profiles(64, 2)
    (v,) = p.bundle(["ab!"])
    edge, a, b = (p._letter(c).astype(int) for c in (0, ord("a"), ord("b")))
    want = edge * np.roll(a, 1) + a * np.roll(b, 1) + b * np.roll(edge, 1)
    assert np.allclose(v, want / np.linalg.norm(want), atol=1e-6)
    assert not p.bundle(["12 !", ""]).any()


def test_held_out_accuracy(spark, small):
    folder = small.replace("0.001", "0.01")
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op5_language_id(spark, folder).collect()
    assert {r.doc_id for r in rows} == set(langs) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]
    assert sum(held) >= 0.97 * len(held)


def test_odd_rows(spark, make_docs):
    docs = make_docs([(1, None), (2, ""), (3, "12 34 !"), (4, "der die das und " * 20_000), (5, "the of and to that"),
                      (5, "the of and to that"), (None, "the of and")])
    docs = docs.withColumn("lang", F.when(F.col("doc_id") == 4, "de").when(F.col("doc_id") == 5, "en")).withColumn("score", F.lit("x"))
    prototypes = learn_languages(docs)
    assert list(prototypes) == ["de", "en"]
    got = sorted((r.doc_id or -1, r.lang_pred) for r in identify(docs, prototypes).collect())
    assert got == [(-1, "en"), (1, "und"), (2, "und"), (3, "und"), (4, "de"), (5, "en"), (5, "en")]
    empty = learn_languages(docs.limit(0))
    assert empty == {} and {r.lang_pred for r in identify(docs, empty).collect()} == {"und"}
    assert identify(docs.limit(0), prototypes).collect() == []
