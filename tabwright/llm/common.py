"""Helpers shared by the corpus operators."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tabwright.session import scratch_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(df: DataFrame, *columns: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text as UTF-8 bytes) and further ``columns``; nothing else reaches the Python tasks."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"), *columns)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, survives lost executors, keeps column pruning.

    The shuffle files that made it have no further use and go at once.
    """
    spark, tidy = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = scratch_path(spark, name), spark.conf.get(tidy, "false")
    spark.conf.set(tidy, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(tidy, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table made by ``written`` that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def first_by_hash(df: DataFrame, by: list[str], key: str, most: int) -> DataFrame:
    """Of each group the ``most`` rows with the smallest unsigned hash of ``key``, and their ``_place`` from 1.

    Groups are counted by the leading zeros of the hash first, so that only about ``most`` to twice as many rows of a group
    are ranked, however many tasks there are. ``by`` holds no nulls; groups are few. ``df`` is read twice.
    """
    h = F.xxhash64(key)
    rows = df.withColumn("_zeros", F.when(h < 0, 0).otherwise(F.lit(64) - F.length(F.bin(h))))
    down = Window.partitionBy(*by).orderBy(F.desc("_zeros"))
    counts = rows.groupBy(*by, "_zeros").agg(F.count("*").alias("_n")).withColumn("_sum", F.sum("_n").over(down))
    bound = counts.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("_sum") >= most, F.col("_zeros"))), F.lit(0)).alias("_bound"))
    near = rows.join(F.broadcast(bound), by).where("_zeros >= _bound").drop("_zeros", "_bound")
    order = Window.partitionBy(*by).orderBy(h < 0, h)
    return near.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= most)


def columns_of(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def pieces_of(batches: Iterable[pa.RecordBatch], rows: int = 2_000, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece has at most ``rows`` rows, and at most ``size`` bytes unless one row is larger.

    Only the working set of a task is bounded by this; every row passes.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_binary(column.type) or pa.types.is_string(column.type):
                lengths += np.diff(np.frombuffer(column.buffers()[1], np.int32, batch.num_rows + 1, 4 * column.offset))
        start, held = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if i > start and (i - start >= rows or held + n > size):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


# A-Z to a-z, all other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def crc_third(doc_id: int | None) -> int:
    return zlib.crc32(str(doc_id).encode()) % 3


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (murmur3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
