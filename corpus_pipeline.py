"""The corpus pipeline: documents are classified, deduplicated, decontaminated, freed of secrets and packed.

Every stage takes (spark, docs, sf_dir) and gives documents with the columns it was given, except the last, which gives
the pieces of the packed sequences. A stage's result is written as Parquet and read again before the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabwright.llm.common import table, written
from tabwright.llm.decontamination import clean_documents
from tabwright.llm.near_dedup import near_duplicates
from tabwright.llm.packing import pack
from tabwright.llm.quality import good_documents
from tabwright.llm.secrets import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier takes for low in quality or toxic go."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of smallest id stays; of its rows, if repeated, one of each kind."""
    found = near_duplicates(docs)
    out = docs.join(found.where("not kept").select("doc_id").distinct(), "doc_id", "left_anti")
    repeated = written(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id"),
                       "repeated-ids")
    if not repeated.isEmpty():
        out = out.join(repeated, "doc_id", "left_anti").unionByName(out.join(repeated, "doc_id", "left_semi").distinct())
    return out.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, encoded ones too, are replaced by a mark; every document stays."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in sequences of at most 4096 tokens."""
    import public_tokenizers
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets),
          ("packing", packing)]
# Classifier, recursive decoding and the tokenizer have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
