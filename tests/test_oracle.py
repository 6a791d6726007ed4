"""Every query with a SQL counterpart gives the same rows as that SQL in another engine."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def rows_of(values):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{v:.5f}" if isinstance(v, float) else str(v)
    return sorted(tuple(plain(v) for v in row) for row in values)


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_query_matches_sql(spark, small, duck, name):
    df = entry_module.queries()[name](spark, small)
    relation = duck.sql(entry_module.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    at = [relation.columns.index(c) for c in columns]
    got = rows_of(df.select(*[f"`{c}`" for c in columns]).collect())
    want = rows_of([r[i] for i in at] for r in relation.fetchall())
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == w or all(a == b or abs(float(a) - float(b)) <= 2e-5 * max(1, abs(float(b))) for a, b in zip(g, w))


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() == 5 and "median" in df.columns


def test_oracles_name_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
