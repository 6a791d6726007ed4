"""Every stage against a brute-force version that shares only the fitted classifier."""

import __spark_entry__ as entry_module
import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabwright.llm.quality import classify
from tabwright.llm.secrets import scan
from tests.llm import test_decontamination, test_near_dedup, test_packing


def test_stages_match_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_dedup", "decontamination", "secrets", "packing"]

    def pairs(df):
        assert df.columns == docs.columns
        return sorted((r.doc_id, r.text) for r in df.collect())
    one = stages["quality"](spark, docs, small)
    keep = {r.doc_id for r in classify(docs, spark.read.parquet(f"{small}/labels.parquet")).where("keep").collect()}
    assert {d for d, _ in pairs(one)} == keep and 0 < len(keep)
    two = stages["near_dedup"](spark, one, small)
    want = {d for d, _, _, kept in test_near_dedup.brute(pairs(one)) if kept}
    assert {d for d, _ in pairs(two)} == want
    three = stages["decontamination"](spark, two, small)
    want = {r[0] for r in test_decontamination.brute(pairs(two), items) if not r[5]}
    assert {d for d, _ in pairs(three)} == want < {d for d, _ in pairs(two)}
    four = stages["secrets"](spark, three, small)
    before, after = dict(pairs(three)), dict(pairs(four))
    assert set(before) == set(after)
    assert all((after[d] == t) == (not scan(t)[1]) and "[SECRET]" in after[d] + "[SECRET]" * (not scan(t)[1])
               for d, t in before.items())
    assert four.where(F.length("text") != F.col("n_chars")).count() == 0
    packed = stages["packing"](spark, four, small).collect()
    test_packing.check(packed, pairs(four), 4096)


def test_run_gives_the_last_stage(spark, small):
    packed = entry_module.queries()["pipeline"](spark, small)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    total = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("d")).collect()
    assert 0 < len(total) < len(texts) and all(r.n == r.d for r in total)
    plain = [r for r in total if not scan(texts[r.doc_id])[1]]
    assert all(r.d == len(tok.encode(texts[r.doc_id], add_special_tokens=False).ids) + 1 for r in plain)


def test_odd_rows(spark, small, make_docs):
    same = "a b c d e f g h"
    docs = make_docs([(1, None), (2, ""), (3, same), (3, same), (4, same), (None, same), (5, "word " * 30_000)])
    docs = docs.withColumn("kept", F.lit("clash")).withColumn("length", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_out = stage(spark, docs, small)
        assert docs_out.columns == docs.columns, name
    left = corpus_pipeline.near_dedup(spark, docs, small)
    assert sorted(r.doc_id or -1 for r in left.collect()) == [-1, 1, 2, 3, 5]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), small).collect() == []
