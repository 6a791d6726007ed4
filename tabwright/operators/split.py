"""Train/test splits that depend on a key alone, so that a row always falls on the same side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabwright.functions.columns import quoted

BUCKETS = 1_000
STEPS = 268_436  # places within a bucket: 28 bits of the digest are used
PLACES = BUCKETS * STEPS


def _digest(key: Column, seed: int) -> Column:
    digest = F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("long")


def hash_bucket(key: Column, seed: int = 42) -> Column:
    """0..999 from the md5 of the key's text and the seed."""
    return _digest(key, seed) % BUCKETS


def hash_place(key: Column, seed: int = 42) -> Column:
    """0..PLACES-1 from the same md5; the buckets follow each other."""
    h = _digest(key, seed)
    return (h % BUCKETS) * STEPS + F.floor(h / BUCKETS)


def in_share(key: Column, share: float, seed: int = 42) -> Column:
    """True for about the given share of keys."""
    return hash_place(key, seed) < round(share * PLACES)


def train_test_split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42,
                     name: str = "split") -> DataFrame:
    """Add ``split``, 'train' or 'test'."""
    return df.withColumn(name, F.when(in_share(quoted(key), test_share, seed), "test").otherwise("train"))


def split_tables(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    test = in_share(quoted(key), test_share, seed)
    return df.where(~test), df.where(test)


def train_val_split_files(files: DataFrame, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Split a file manifest by path."""
    return train_test_split(files, "path", share, seed)


def fold_of(key: str, folds: int, seed: int = 42) -> Column:
    """Cross-validation fold 0..folds-1 of a row."""
    return (hash_bucket(quoted(key), seed) % folds).cast("int")
