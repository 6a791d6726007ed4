"""Folders whose sub-directories name the class of the files inside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabwright.operators.stats import dense_codes


def labelled_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, label, class_index) of each file; classes are numbered in name order."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
             .load(folder).select("path"))
    labelled = files.withColumn("label", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    codes = dense_codes(labelled.select("label").distinct(), ["label"], "class_index")
    return codes.attach(labelled, ["label"]).select("path", "label", "class_index")
