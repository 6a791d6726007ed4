"""Readers, writers, working copies, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.functions.columns import round_doubles
from tabwright.operators import project
from tabwright.plans.registry import NULLED, blanks, query, r, with_nulls
from tabwright.session import scratch_path
from tabwright.sources import (clear_checkpoint, labelled_files, load_checkpoint, load_table, read_csv,
                               save_checkpoint, write_csv, write_missing_report)
from tabwright.operators.split import train_val_split_files

CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
CUSTOMER_SCHEMA = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("scan_parquet", "SELECT r_regionkey, r_name, n_nationkey, n_name FROM region JOIN nation ON r_regionkey = n_regionkey")
def scan_parquet(spark, sf):
    region, nation = load_table(spark, sf, "region"), load_table(spark, sf, "nation")
    return region.join(nation, region.r_regionkey == nation.n_regionkey).select(
        "r_regionkey", "r_name", "n_nationkey", "n_name")


@query("scan_csv", "SELECT s_suppkey, s_name, CAST(s_nationkey AS INT) AS s_nationkey, s_acctbal FROM supplier")
def scan_csv(spark, sf):
    path = scratch_path(spark, "supplier-csv")
    write_csv(load_table(spark, sf, "supplier"), path)
    return read_csv(spark, path).withColumn("s_suppkey", F.col("s_suppkey").cast("long"))


@query("sink_csv", CUSTOMER)
def sink_csv(spark, sf):
    path = scratch_path(spark, "customer-csv")
    write_csv(load_table(spark, sf, "customer"), path)
    return read_csv(spark, path, schema=CUSTOMER_SCHEMA)


@query("checkpoint_save", CUSTOMER)
def checkpoint_save(spark, sf):
    key = f"save-{sf.strip('/').replace('/', '-')}"
    save_checkpoint(load_table(spark, sf, "customer"), key)
    return load_checkpoint(spark, key)


@query("checkpoint_load", CUSTOMER.replace("c_acctbal,", "c_acctbal + 1 AS c_acctbal,"))
def checkpoint_load(spark, sf):
    key = f"load-{sf.strip('/').replace('/', '-')}"
    save_checkpoint(load_table(spark, sf, "customer"), key)
    save_checkpoint(load_checkpoint(spark, key).withColumn("c_acctbal", F.col("c_acctbal") + 1), key)
    return load_checkpoint(spark, key)


@query("checkpoint_clear", "SELECT count(*) AS rows, 1 AS cleared FROM customer")
def checkpoint_clear(spark, sf):
    key = f"clear-{sf.strip('/').replace('/', '-')}"
    customer = load_table(spark, sf, "customer")
    save_checkpoint(customer, key)
    return customer.agg(F.count("*").alias("rows")).withColumn("cleared", F.lit(int(clear_checkpoint(spark, key))))


MISSING_COLUMNS = (("event_id", "bigint"), ("value_n", "double"), ("user_n", "bigint"), ("type_n", "string"),
                   ("k_n", "double"), ("sparse_n", "double"))
MISSING_SQL = f"WITH {NULLED} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS total_missing,
    {r(f"count(*) FILTER ({c} IS NULL) / count(*)")} AS proportion, '{t}' AS dtype FROM nulled"""
    for c, t in MISSING_COLUMNS)


@query("missing_report_sink", MISSING_SQL)
def missing_report_sink(spark, sf):
    path = write_missing_report(blanks(spark, sf), scratch_path(spark, "report"))
    return round_doubles(read_csv(spark, path, schema="column string, total_missing long, proportion double, dtype string"))


def _label_tree(spark, sf):
    """Documents as one file per (lang, source), in folders named after the language."""
    path = scratch_path(spark, "documents")
    docs = load_table(spark, sf, "documents").select("lang", F.concat_ws(" ", "source", F.col("doc_id").cast("string")).alias("line"))
    docs.write.partitionBy("lang").text(path)
    return path


@query("scan_labelled_files")
def scan_labelled_files(spark, sf):
    files = labelled_files(spark, _label_tree(spark, sf), "*.txt")
    return files.groupBy("label", "class_index").agg(F.count("*").alias("files"))


@query("train_val_split_files")
def train_val_split(spark, sf):
    return train_val_split_files(labelled_files(spark, _label_tree(spark, sf), "*.txt")).select("label", "split")


@query("select_columns", "SELECT l_orderkey, l_quantity FROM lineitem")
def select_columns(spark, sf):
    return project.select_columns(load_table(spark, sf, "lineitem"), ["l_orderkey", "l_quantity"])


@query("drop_columns", "SELECT event_id, ts, event_type, value FROM events")
def drop_columns(spark, sf):
    return project.drop_columns(load_table(spark, sf, "events"), ["user_id", "props", "absent"])[0]


@query("search_rows", """SELECT * FROM orders
  WHERE regexp_matches(CAST(o_orderkey AS VARCHAR), '(?i)urgent|99$') OR regexp_matches(CAST(o_custkey AS VARCHAR), '(?i)urgent|99$')
     OR regexp_matches(o_orderstatus, '(?i)urgent|99$') OR regexp_matches(CAST(o_totalprice AS VARCHAR), '(?i)urgent|99$')
     OR regexp_matches(CAST(o_orderdate AS VARCHAR), '(?i)urgent|99$') OR regexp_matches(o_orderpriority, '(?i)urgent|99$')""")
def search_rows(spark, sf):
    return project.search_rows(load_table(spark, sf, "orders"), "urgent|99$")


@query("filter_compare", """SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_shipdate FROM lineitem
  WHERE l_quantity >= 25 AND l_returnflag <> 'N' AND l_discount < 0.05 AND l_shipdate > TIMESTAMP '1995-06-30'""")
def filter_compare(spark, sf):
    return project.filter_compare(load_table(spark, sf, "lineitem"), [
        ("l_quantity", ">=", 25), ("l_returnflag", "!=", "N"), ("l_discount", "<", 0.05),
        ("l_shipdate", ">", "1995-06-30")]).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate")


@query("flag_rows", "SELECT event_id, value, CASE WHEN value > 100 THEN 1 ELSE 0 END AS highlight FROM events")
def flag_rows(spark, sf):
    return project.flag_rows(load_table(spark, sf, "events").select("event_id", "value"), "value", ">", 100)


@query("preview_head", "SELECT * FROM customer ORDER BY c_custkey LIMIT 5")
def preview_head(spark, sf):
    return project.preview_head(load_table(spark, sf, "customer"), ["c_custkey"])


def _texts(spark, sf):
    """Customers with their numbers and a mixed column as text."""
    return load_table(spark, sf, "customer").select(
        "c_custkey", F.col("c_acctbal").cast("string").alias("balance"),
        F.when(F.col("c_acctbal") > 8000, F.col("c_mktsegment")).otherwise(F.col("c_nationkey").cast("string")).alias("mixed"),
        "c_mktsegment")


TEXTS = """texts AS (SELECT c_custkey, CAST(c_acctbal AS VARCHAR) AS balance,
  CASE WHEN c_acctbal > 8000 THEN c_mktsegment ELSE CAST(c_nationkey AS VARCHAR) END AS mixed, c_mktsegment FROM customer)"""


@query("to_float_all", f"""WITH {TEXTS} SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, TRY_CAST(balance AS DOUBLE) AS balance,
  TRY_CAST(mixed AS DOUBLE) AS mixed, TRY_CAST(c_mktsegment AS DOUBLE) AS c_mktsegment FROM texts""")
def to_float_all(spark, sf):
    return project.to_float_all(_texts(spark, sf))


@query("to_float_guarded", f"""WITH {TEXTS} SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, TRY_CAST(balance AS DOUBLE) AS balance,
  TRY_CAST(mixed AS DOUBLE) AS mixed FROM texts""")
def to_float_guarded(spark, sf):
    return project.to_float_guarded(_texts(spark, sf))


@query("coerce_numeric", f"WITH {TEXTS} SELECT c_custkey, balance, TRY_CAST(mixed AS DOUBLE) AS mixed, c_mktsegment FROM texts")
def coerce_numeric(spark, sf):
    return project.coerce_numeric(_texts(spark, sf), "mixed")


@query("sample_every_k", f"""WITH {NULLED}, m AS (SELECT event_id, CAST(value_n IS NULL AS INT) AS value_n, CAST(user_n IS NULL AS INT) AS user_n,
  row_number() OVER (ORDER BY event_id) - 1 AS pos, count(*) OVER () AS n FROM nulled)
  SELECT event_id, value_n, user_n FROM m WHERE n <= 100 OR pos % greatest(1, n // 100) = 0""")
def sample_every_k(spark, sf):
    mask = with_nulls(spark, sf).select("event_id", F.col("value_n").isNull().cast("int").alias("value_n"),
                                        F.col("user_n").isNull().cast("int").alias("user_n"))
    return project.sample_every_k(mask, ["event_id"])


@query("apply_user_function", """SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
  FROM lineitem GROUP BY l_returnflag""")
def apply_user_function(spark, sf):
    return project.apply_user_function(
        load_table(spark, sf, "lineitem"),
        lambda t: t.groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")))


@query("apply_user_batches", "SELECT event_id, value * 2 AS doubled FROM events")
def apply_user_batches(spark, sf):
    return project.apply_user_batches(load_table(spark, sf, "events").select("event_id", "value"),
                                      lambda pdf: pdf.assign(doubled=pdf["value"] * 2)[["event_id", "doubled"]],
                                      "event_id long, doubled double")


