"""CSV and Parquet tables, and named working copies of a table."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tabwright.functions.columns import nan_to_null
from tabwright.operators.missing import check_missing
from tabwright.session import checkpoint_root

ENCODINGS = ("UTF-8", "ISO-8859-1")  # by the names that Spark knows; the second reads any bytes
# A quote inside a quoted cell is doubled, and such a cell may hold line breaks.
FORM = {"quote": '"', "escape": '"'}


def load_table(spark: SparkSession, folder: str, name: str, nan_is_missing: bool = False) -> DataFrame:
    """One Parquet table.

    Parquet has NULL for missing values. ``nan_is_missing`` turns NaN into NULL as
    well, at the price of filters on those columns no longer reaching the scan.
    """
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    return nan_to_null(table) if nan_is_missing else table


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             encodings: Sequence[str] = ENCODINGS, header: bool = True, multi_line: bool = True) -> DataFrame:
    """CSV with a header row; the first encoding that decodes the whole file wins.

    Whether a file is UTF-8 is decided on its bytes, by one scan that splits files and stops at the first bad line; a
    replacement character that the file itself holds is text like any other. Cells may hold line breaks, for which a file
    must be read by one task: with ``multi_line=False`` they may not, and large files are split. Give ``schema`` to avoid
    the extra pass that type inference costs.
    """
    for encoding in encodings:
        if encoding.lower().replace("-", "") == "utf8" and not spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty():
            continue
        reader = spark.read.option("header", header).option("encoding", encoding).options(**FORM, multiLine=multi_line)
        if schema is not None:
            return nan_to_null(reader.schema(schema).csv(path))
        return nan_to_null(reader.option("inferSchema", True).csv(path))
    raise ValueError(f"none of the encodings {', '.join(encodings)} reads {path}")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).options(**FORM).csv(path)


def _stage(spark: SparkSession, key: str):
    """Hadoop file system and folder of a working table's versions."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{checkpoint_root(spark).rstrip('/')}/tabwright/stages/{key}")
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def save_checkpoint(df: DataFrame, key: str) -> None:
    """Persist the working table under a session key.

    Each save is a new version, so a table derived from the stored one can be saved under the same key.
    """
    _, folder = _stage(df.sparkSession, key)
    df.write.parquet(f"{folder}/{time.time_ns():020d}")


def load_checkpoint(spark: SparkSession, key: str) -> DataFrame:
    """The last complete version saved under ``key``."""
    fs, folder = _stage(spark, key)
    finished = fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/*/_SUCCESS"))
    versions = sorted(str(status.getPath().getParent()) for status in finished or [])
    if not versions:
        raise ValueError(f"no table saved under {key}")
    return spark.read.parquet(versions[-1])


def clear_checkpoint(spark: SparkSession, key: str) -> bool:
    """Delete a working table; says whether there was one."""
    fs, folder = _stage(spark, key)
    return fs.delete(folder, True)


def write_missing_report(df: DataFrame, folder: str) -> str:
    """Write the missing-value table of ``df`` below ``folder``."""
    path = f"{folder.rstrip('/')}/missing_analysis.csv"
    write_csv(check_missing(df), path)
    return path
