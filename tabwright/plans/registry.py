"""Registration of queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabwright.sources.tables import load_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register ``fn`` under ``name``; ``sql`` runs on the same tables in another engine."""
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def r(expr: str, places: int = 6) -> str:
    """SQL for a rounded double, with -0.0 written as 0.0."""
    return f"(round(CAST({expr} AS DOUBLE), {places}) + 0.0)"


def with_nulls(spark: SparkSession, folder: str) -> DataFrame:
    """All events, with missing values put into further columns by rule; the tables have none of their own."""
    e = load_table(spark, folder, "events")

    def blank(every: int, value):
        return F.when(F.col("event_id") % every != 0, value)
    return e.select("event_id", "ts", "user_id", "event_type", "value",
                    blank(7, F.col("value")).alias("value_n"), blank(11, F.col("user_id")).alias("user_n"),
                    blank(5, F.col("event_type")).alias("type_n"),
                    blank(77, F.get_json_object("props", "$.k").cast("double")).alias("k_n"),
                    F.when(F.col("event_id") % 10 == 0, F.col("value")).alias("sparse_n"))


# The same rule in SQL: rows are kept, values are blanked.
NULLED = """nulled AS (
  SELECT event_id, ts, user_id, event_type, value,
         CASE WHEN event_id % 7 <> 0 THEN value END AS value_n,
         CASE WHEN event_id % 11 <> 0 THEN user_id END AS user_n,
         CASE WHEN event_id % 5 <> 0 THEN event_type END AS type_n,
         CASE WHEN event_id % 77 <> 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k_n,
         CASE WHEN event_id % 10 = 0 THEN value END AS sparse_n
  FROM events)"""


def blanks(spark: SparkSession, folder: str) -> DataFrame:
    """The key and the five columns with missing values."""
    return with_nulls(spark, folder).select("event_id", "value_n", "user_n", "type_n", "k_n", "sparse_n")


LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
              "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
