"""Counts of characters over whole texts, on their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from tabwright.functions.columns import quoted

COUNTS = ("words", "lines", "digits", "capitals", "stops")
PIECE = 1 << 22  # bytes looked at together, or one text


def _marks(b: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
    """Where something counted begins, in the order of ``COUNTS``. Bytes of longer UTF-8 characters are never below 128."""
    space = (b - np.uint8(9) < 5) | (b == 32)
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins[starts] = space[starts]  # a run does not go on from the text before
    yield begins
    yield b == 10
    yield b - np.uint8(48) < 10
    yield b - np.uint8(65) < 26
    yield (b == 46) | (b == 33) | (b == 63)


def byte_counts(texts: pa.Array) -> np.ndarray:
    """texts x ``COUNTS``: pieces between white space, pieces between line feeds, 0-9, A-Z, and . ! ?"""
    texts = texts.cast(pa.large_string())
    out = np.zeros((len(texts), len(COUNTS)))
    out[:, :2] = 1  # n separators leave n + 1 pieces
    _, ends, data = texts.buffers()
    if not len(texts) or data is None:
        return out
    ends = np.frombuffer(ends, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + PIECE, "right")) - 1)
        b, cuts = data[ends[first]:ends[last]], ends[first:last + 1] - ends[first]
        for i, mark in enumerate(_marks(b, cuts[:-1][cuts[:-1] < len(b)])):
            out[first:last, i] += np.diff(np.searchsorted(np.flatnonzero(mark), cuts))
        first = last
    return out


def count_texts(table: DataFrame, text: str = "text") -> DataFrame:
    """``COUNTS`` as doubles in place of the text; null where the text is null."""
    kept = [f for f in table.schema.fields if f.name != text]
    schema, width = StructType([*kept, *[StructField(c, DoubleType()) for c in COUNTS]]), len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, gone = byte_counts(b.column(width)), b.column(width).is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*b.columns[:width], *[pa.array(x, mask=gone) for x in found.T]], names=schema.names)
    return table.select(*[quoted(f.name) for f in kept], quoted(text)).mapInArrow(run, schema)
