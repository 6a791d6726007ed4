"""Counts over texts, on bytes, against the same counts by patterns."""

import pytest
from pyspark.sql import functions as F

from tabwright.functions import texts
from tabwright.plans import models

ODD = ["", " ", "\n", "a", " a", "a ", "a  b\n\n c\t\x0b\x0c\r", "Ärger É 7 ٣ ４!?", "1.5 A.B", "  x y", None, "ends.\n", "\nstarts", "  ", "Z" * 50]


@pytest.fixture
def by_patterns():
    t = F.col("text")
    return [F.size(F.split(t, r"\s+")), F.size(F.split(t, "\n")), *[F.length(F.regexp_replace(t, p, "")) for p in ("[^0-9]", "[^A-Z]", "[^.!?]")]]


@pytest.mark.parametrize("piece", [3, 1 << 22])
def test_counts_by_bytes(spark, by_patterns, monkeypatch, piece):
    table = spark.createDataFrame(list(enumerate(ODD * 3)), "id int, text string").coalesce(1)
    wanted = [tuple(r) for r in table.select("id", *[e.cast("double") for e in by_patterns]).orderBy("id").collect()]
    monkeypatch.setattr(texts, "PIECE", piece)
    import pyarrow as pa
    own = texts.byte_counts(pa.array(ODD * 3).slice(2))
    assert [tuple(x) for x, t in zip(own, (ODD * 3)[2:]) if t is not None] == [w[1:] for w in wanted[2:] if w[1] is not None]
    assert [tuple(r) for r in texts.count_texts(table).orderBy("id").collect()] == wanted


def test_one_file_is_dealt_out(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i}", 6) for i in range(50)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars int").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(models, "ROWS_PER_TASK", 10)
    found = models.texts(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 5
    assert found.count() == 50
