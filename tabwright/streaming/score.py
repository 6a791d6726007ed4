"""Scoring of stored and of streaming rows with the same fitted objects."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tabwright.operators.models.recipe import drop_helpers
from tabwright.session import scratch_path


def batch_score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``prediction``; works on a streaming table as well."""
    return drop_helpers(model.transform(df))


def apply_fitted(df: DataFrame, transforms: Iterable) -> DataFrame:
    """Fitted scalers, fences and power transforms one after another."""
    for t in transforms:
        df = t.transform(df) if hasattr(t, "transform") else t.clamp(df)
    return df


def stream_parquet(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def write_scored(df: DataFrame, path: str, checkpoint: str | None = None) -> StreamingQuery:
    """Append every available row of a stream to a Parquet table exactly once, then stop."""
    checkpoint = checkpoint or scratch_path(df.sparkSession, "stream")
    return (df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())
