"""Overview tables and quality rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.functions.columns import round_doubles
from tabwright.operators import impute, profile, validate
from tabwright.plans.registry import LINE_NUMBERS, NULLED, blanks, query, r, with_nulls
from tabwright.plans.sources import MISSING_COLUMNS
from tabwright.sources import load_table


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


@query("dataset_info", f"WITH {NULLED} " + _union(
    f"""SELECT '{c}' AS "column", '{t}' AS dtype, count({c}) AS non_null, count(*) AS rows, 6 AS columns FROM nulled"""
    for c, t in MISSING_COLUMNS))
def dataset_info(spark, sf):
    return profile.dataset_info(blanks(spark, sf))


@query("type_table", f"WITH {NULLED} " + _union(
    f"""SELECT '{c}' AS "column", '{t}' AS dtype, count({c}) AS non_null, count(*) - count({c}) AS nulls FROM nulled"""
    for c, t in MISSING_COLUMNS))
def type_table(spark, sf):
    return profile.type_table(blanks(spark, sf))


def describe_sql(column: str, table: str, by: str = "", places: int = 6) -> str:
    lead, tail = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return f"""SELECT {lead}'{column}' AS "column", count({column}) AS "count", {r(f"avg({column})", places)} AS mean,
      {r(f"stddev_samp({column})", places)} AS std, {r(f"min({column})", places)} AS min,
      {r(f"quantile_cont({column}, 0.25)", places)} AS "25%", {r(f"quantile_cont({column}, 0.5)", places)} AS "50%",
      {r(f"quantile_cont({column}, 0.75)", places)} AS "75%", {r(f"max({column})", places)} AS max FROM {table}{tail}"""


@query("describe_numeric", _union(describe_sql(c, "lineitem") for c in LINE_NUMBERS))
def describe_numeric(spark, sf):
    return round_doubles(profile.describe_numeric(load_table(spark, sf, "lineitem"), LINE_NUMBERS))


def _describe_text(column: str) -> str:
    return f"""SELECT '{column}' AS "column", sum(n)::BIGINT AS "count", NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min,
      NULL::DOUBLE AS "25%", NULL::DOUBLE AS "50%", NULL::DOUBLE AS "75%", NULL::DOUBLE AS max, count(*) AS "unique",
      first({column} ORDER BY n DESC, {column}) AS top, max(n) AS freq
      FROM (SELECT {column}, count(*) AS n FROM nulled WHERE {column} IS NOT NULL GROUP BY {column})"""


@query("describe_all", f"WITH {NULLED} " + _union(
    [f"""SELECT *, NULL::BIGINT AS "unique", NULL AS top, NULL::BIGINT AS freq FROM ({describe_sql(c, "nulled")})"""
     for c in ("value_n", "user_n", "k_n")] + [_describe_text("type_n"), _describe_text("event_type")]))
def describe_all(spark, sf):
    return round_doubles(profile.describe_all(with_nulls(spark, sf).select("value_n", "user_n", "k_n", "type_n", "event_type")))


@query("overview_metrics", f"""WITH {NULLED} SELECT count(*) AS rows, 6 AS columns,
  CAST(sum((value_n IS NULL)::INT + (user_n IS NULL)::INT + (type_n IS NULL)::INT + (k_n IS NULL)::INT + (sparse_n IS NULL)::INT)
       AS BIGINT) AS missing_cells FROM nulled""")
def overview_metrics(spark, sf):
    return profile.overview_metrics(blanks(spark, sf)).drop("text_bytes")


@query("overview_size", """SELECT CAST(sum(strlen(c_name) + strlen(c_mktsegment) + strlen(CAST(c_custkey AS VARCHAR))) AS BIGINT) AS text_bytes
  FROM customer""")
def overview_size(spark, sf):
    return profile.overview_metrics(load_table(spark, sf, "customer").select("c_name", "c_mktsegment", "c_custkey")).select(
        "text_bytes")


def _column_profile_sql() -> str:
    parts = []
    for c, t in (("user_n", "bigint"), ("type_n", "string"), ("event_type", "string")):
        parts.append(f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) - count({c}) AS missing,
          {r(f"avg(({c} IS NULL)::INT) * 100", 1)} AS missing_pct, count(DISTINCT {c}) AS "distinct",
          (SELECT string_agg(CAST({c} AS VARCHAR), ', ' ORDER BY event_id) FROM
            (SELECT event_id, {c} FROM nulled WHERE {c} IS NOT NULL ORDER BY event_id LIMIT 3)) AS samples FROM nulled""")
    return f"WITH {NULLED} " + _union(parts)


@query("column_profile", _column_profile_sql())
def column_profile(spark, sf):
    t = with_nulls(spark, sf).select("event_id", "user_n", "type_n", "event_type")
    return profile.column_profile(t, ["event_id"]).where(F.col("column") != "event_id")


@query("distinct_values", "SELECT DISTINCT p_type FROM part")
def distinct_values(spark, sf):
    return profile.distinct_values(load_table(spark, sf, "part"), "p_type")


@query("validate_empty")
def validate_empty(spark, sf):
    empty = validate.validate_empty(load_table(spark, sf, "lineitem"))
    return spark.createDataFrame([(int(empty),)], "is_empty int")


@query("validate_missing_by_column", f"WITH {NULLED} SELECT * FROM (" + _union(
    f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing,
    {r(f"(count(*) - count({c})) / count(*) * 100", 2)} AS missing_pct FROM nulled""" for c, _ in MISSING_COLUMNS)
    + ") WHERE missing > 0")
def validate_missing_by_column(spark, sf):
    return validate.validate_missing_by_column(blanks(spark, sf))


@query("validate_categorical")
def validate_categorical(spark, sf):
    return validate.validate_categorical(load_table(spark, sf, "lineitem"))


@query("validate_near_constant", """WITH f AS (SELECT CAST(toxic AS VARCHAR) AS toxic, CAST(quality AS VARCHAR) AS quality FROM labels),
  s AS (SELECT 'toxic' AS "column", max(n) / sum(n) AS share FROM (SELECT count(*) AS n FROM f GROUP BY toxic)
        UNION ALL SELECT 'quality', max(n) / sum(n) FROM (SELECT count(*) AS n FROM f GROUP BY quality))
  SELECT "column", """ + r("share") + """ AS top_share FROM s WHERE share > 0.6""")
def validate_near_constant(spark, sf):
    return round_doubles(validate.validate_near_constant(load_table(spark, sf, "labels").select("toxic", "quality"), 0.6))


@query("check_features_for_model", f"""WITH {NULLED}, s AS (SELECT count(*) - count(value_n) AS a, count(*) - count(user_n) AS b,
    count(*) - count(type_n) AS c, count(*) FILTER (event_type IS NOT NULL AND TRY_CAST(event_type AS DOUBLE) IS NULL) AS d,
    count(DISTINCT type_n) AS k FROM nulled)
  SELECT 'categorical_feature' AS rule, 'event_type' AS "column", 'warning' AS severity, 1.0::DOUBLE AS value FROM s
  UNION ALL SELECT 'missing_in_feature', 'value_n', 'warning', a::DOUBLE FROM s WHERE a > 0
  UNION ALL SELECT 'missing_in_feature', 'user_n', 'warning', b::DOUBLE FROM s WHERE b > 0
  UNION ALL SELECT 'non_numeric_values', 'event_type', 'warning', d::DOUBLE FROM s WHERE d > 0
  UNION ALL SELECT 'missing_in_target', 'type_n', 'error', c::DOUBLE FROM s WHERE c > 0
  UNION ALL SELECT CASE WHEN k > 10 THEN 'many_classes' ELSE 'single_class' END, 'type_n',
    CASE WHEN k > 10 THEN 'warning' ELSE 'error' END, k::DOUBLE FROM s WHERE k > 10 OR k <= 1""")
def check_features_for_model(spark, sf):
    return validate.check_features_for_model(with_nulls(spark, sf), ["value_n", "user_n", "event_type"], "type_n")


@query("cleaning_report", f"""WITH {NULLED} SELECT count(*) AS original_rows, 6 AS original_columns, count(*) AS final_rows,
  5 AS final_columns, 1 AS columns_dropped, CAST(sum((value_n IS NULL)::INT + (user_n IS NULL)::INT + (type_n IS NULL)::INT
  + (k_n IS NULL)::INT) AS BIGINT) AS remaining_nulls FROM nulled""")
def cleaning_report(spark, sf):
    before = blanks(spark, sf)
    after = impute.drop_sparse_columns(before)
    return validate.cleaning_report(before, after, len(before.columns) - len(after.columns))
