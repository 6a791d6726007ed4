"""Categorical encodings."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabwright.functions.columns import round_doubles
from tabwright.operators import encode
from tabwright.plans.registry import NULLED, blanks, query, r, with_nulls
from tabwright.sources import load_table


def _parts(spark, sf):
    return load_table(spark, sf, "part").select("p_partkey", "p_type", "p_retailprice")


@query("encode_label", """SELECT p_partkey, dense_rank() OVER (ORDER BY p_type) - 1 AS p_type, p_retailprice FROM part""")
def encode_label(spark, sf):
    return encode.encode_label(_parts(spark, sf), "p_type")


@query("encode_label_inverse", "SELECT p_partkey, p_type, p_retailprice FROM part")
def encode_label_inverse(spark, sf):
    parts = _parts(spark, sf)
    codes = encode.label_codes(parts, "p_type")
    return encode.encode_label_inverse(encode.encode_label(parts, "p_type", codes), "p_type", codes)


# The event types of the sample tables, which name the one-hot columns.
TYPES = ("click", "error", "purchase", "signup", "view")


@query("encode_one_hot", f"WITH {NULLED} SELECT event_id, " + ", ".join(
    f"coalesce(type_n = '{t}', false)::INT::DOUBLE AS type_n_{t}" for t in TYPES)
    + ", (type_n IS NULL)::INT::DOUBLE AS type_n_nan FROM nulled")
def encode_one_hot(spark, sf):
    return encode.encode_one_hot(blanks(spark, sf).select("event_id", "type_n"), "type_n")


@query("encode_one_hot_vector", f"WITH {NULLED} SELECT event_id, v.pos AS pos FROM (SELECT event_id, CASE type_n "
       + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(TYPES)) + f" ELSE {len(TYPES)} END AS pos FROM nulled) v")
def encode_one_hot_vector(spark, sf):
    t = encode.encode_one_hot_vector(blanks(spark, sf).select("event_id", "type_n"), "type_n")
    return t.select("event_id", (F.array_position(vector_to_array("type_n_onehot"), F.lit(1.0)) - 1).cast("int").alias("pos"))


@query("encode_mean", f"""WITH {NULLED}, g AS (SELECT type_n AS t, avg(value) AS m FROM nulled GROUP BY type_n)
  SELECT event_id, type_n, {r('m')} AS type_n_mean_encoded FROM nulled LEFT JOIN g ON type_n = t""")
def encode_mean(spark, sf):
    t = with_nulls(spark, sf).select("event_id", "type_n", "value")
    return round_doubles(encode.encode_mean(t, "type_n", "value").drop("value"))


@query("encode_target", f"""WITH g AS (SELECT p_type AS t, avg(p_retailprice) AS m FROM part GROUP BY p_type)
  SELECT p_partkey, {r('m')} AS p_type, p_retailprice FROM part LEFT JOIN g ON p_type = t""")
def encode_target(spark, sf):
    return round_doubles(encode.encode_target(_parts(spark, sf), "p_type", "p_retailprice"))


@query("encode_frequency", f"""WITH {NULLED}, g AS (SELECT type_n AS t, count(*) AS n FROM nulled GROUP BY type_n)
  SELECT event_id, type_n, n AS type_n_freq_encoded FROM nulled LEFT JOIN g ON type_n = t""")
def encode_frequency(spark, sf):
    return encode.encode_frequency(blanks(spark, sf).select("event_id", "type_n"), "type_n")


@query("encode_binary", """WITH s AS (SELECT p_type AS t, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS code FROM part GROUP BY p_type)
  SELECT p_partkey, p_type, ((code >> 2) & 1)::INT AS p_type_bin_0, ((code >> 1) & 1)::INT AS p_type_bin_1, (code & 1)::INT AS p_type_bin_2
  FROM part JOIN s ON p_type = t""")
def encode_binary(spark, sf):
    return encode.encode_binary(_parts(spark, sf).select("p_partkey", "p_type"), "p_type", ["p_partkey"])
