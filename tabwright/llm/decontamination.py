"""Benchmark decontamination with an FM-index per shard of training text.

A shard is a bounded group of documents in one task. Its words become symbols: the benchmark's words have numbers, and
stretches of them too short for any test phrase are left out, as is every other word, since no phrase can lie there. The
index of a shard is the Burrows-Wheeler transform of the symbols in a wavelet matrix with rank directories, and every
sixteenth suffix position. All test phrases are searched backward together; the rows found walk back to a sampled
position, which locates the occurrences, and their spans are merged.

The benchmark is sent to the tasks in blocks of bounded size, one pass and one block at a time. What a block hits depends on
a text alone: all passes but the last write the spans found under the digest of the text, and the last one adds them.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from tabwright.llm.common import LOWER, columns_of, pieces_of, table, texts, written
from tabwright.llm.registry import query

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")  # fixed value, over UTF-8 bytes
STOP, GAP = 0, 1  # end of the shard, end of a stretch


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall((text or b"").translate(LOWER))


class Phrases:
    """The distinct windows of some benchmark items as symbol sequences, with the items they come from."""

    def __init__(self, items: list[tuple[int, bytes | None]], width: int):
        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = defaultdict(set)
        for item, text in items:
            symbols = [self.numbers.setdefault(w, len(self.numbers) + 2) for w in words_of(text)]
            for i in range(max(1, len(symbols) - width + 1)):
                if symbols:
                    owners[tuple(symbols[i:i + width])].add(item)
        self.windows = list(owners)
        self.owners = [sorted(owners[w]) for w in self.windows]
        self.lengths = np.array([len(w) for w in self.windows], np.int64)
        self.least = int(self.lengths.min()) if len(self.lengths) else 0


class FMIndex:
    """Self-index over a sequence of symbols below ``sigma`` that ends in its only STOP."""

    def __init__(self, symbols: np.ndarray, sigma: int, every: int = 16):
        n = len(symbols)
        order = self._suffix_order(symbols)
        last = symbols[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])
        self.levels, self.zeros = [], []
        for bit in reversed(range(max(1, int(sigma - 1).bit_length()))):
            ones = last >> bit & 1
            self.levels.append((bit, np.concatenate([[0], np.cumsum(ones)]).astype(np.int32)))
            self.zeros.append(n - int(self.levels[-1][1][-1]))
            last = np.concatenate([last[ones == 0], last[ones == 1]])
        sampled = order % every == 0
        self.sampled = sampled
        self.sample_rank = np.concatenate([[0], np.cumsum(sampled)]).astype(np.int32)
        self.samples = order[sampled]
        self.n = n

    @staticmethod
    def _suffix_order(symbols: np.ndarray) -> np.ndarray:
        """Suffix array by prefix doubling."""
        rank, step, n = symbols.astype(np.int64), 1, len(symbols)
        while True:
            after = np.zeros(n, np.int64)
            after[:-step] = rank[step:] + 1 if step < n else 0
            key = rank * (max(int(rank.max()), n) + 2) + after
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            if rank[order[-1]] == n - 1:
                return order
            step *= 2

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each row."""
        start, at = np.zeros_like(row), row
        for (bit, ones), zeros in zip(self.levels, self.zeros):
            one = symbol >> bit & 1 == 1
            start = np.where(one, zeros + ones[start], start - ones[start])
            at = np.where(one, zeros + ones[at], at - ones[at])
        return at - start

    def symbol_at(self, row: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(row)
        for (bit, ones), zeros in zip(self.levels, self.zeros):
            one = ones[row + 1] - ones[row]
            symbol |= one.astype(np.int64) << bit
            row = np.where(one == 1, zeros + ones[row], row - ones[row])
        return symbol

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of the suffixes that start with each pattern (rows of equal length)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for column in patterns.T[::-1]:
            live = np.flatnonzero(low < high)
            c = column[live]
            low[live], high[live] = self.first[c] + self.rank(c, low[live]), self.first[c] + self.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by walking back to the nearest sampled suffix."""
        position, row, walking = np.zeros(len(rows), np.int64), rows.copy(), np.arange(len(rows))
        steps = 0
        while len(walking):
            here = row[walking]
            done = self.sampled[here]
            position[walking[done]] = self.samples[self.sample_rank[here[done]]] + steps
            walking, here = walking[~done], here[~done]
            c = self.symbol_at(here)
            row[walking] = self.first[c] + self.rank(c, here)
            steps += 1
        return position


def find_phrases(docs: list[list[bytes]], phrases: Phrases) -> tuple[list[np.ndarray], list[set[int]]]:
    """For each document of a shard the words hit, as merged [start, end) rows, and the items that occur."""
    spans, items = [np.zeros((0, 2), np.int64)] * len(docs), [set() for _ in docs]
    if not phrases.windows:
        return spans, items
    parts, owner, place = [], [], []
    for d, words in enumerate(docs):
        symbols = np.fromiter((phrases.numbers.get(w, 0) for w in words), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate([[0], symbols > 0, [0]])))
        for a, b in edges.reshape(-1, 2).tolist():
            if b - a >= phrases.least:
                parts += [symbols[a:b], [GAP]]
                owner.append(np.full(b - a + 1, d))
                place.append(np.arange(a, b + 1))
    if not parts:
        return spans, items
    owner, place = np.concatenate(owner), np.concatenate(place)
    index = FMIndex(np.concatenate([*parts, [STOP]]).astype(np.int64), len(phrases.numbers) + 2)
    found = []
    for length in np.unique(phrases.lengths).tolist():
        which = np.flatnonzero(phrases.lengths == length)
        low, high = index.search(np.array([phrases.windows[w] for w in which.tolist()], np.int64))
        times = high - low
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        at = index.locate(rows)
        found.append(np.stack([owner[at], place[at], place[at] + length, np.repeat(which, times)], 1))
    found = np.concatenate(found)
    for d, w in np.unique(found[:, [0, 3]], axis=0).tolist():
        items[d].update(phrases.owners[w])
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    for d in np.unique(found[:, 0]).tolist():
        a, b = np.searchsorted(found[:, 0], [d, d + 1])
        spans[d] = merged(found[a:b, 1:3])
    return spans, items


def merged(spans: np.ndarray) -> np.ndarray:
    """Union of [start, end) rows, as disjoint rows in order."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    fresh = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[fresh, 0], reach[np.append(np.flatnonzero(fresh)[1:] - 1, len(spans) - 1)]], 1)


def benchmark_blocks(benchmark: DataFrame, size: int = 4 << 20) -> Iterator[list[tuple[int, bytes]]]:
    """The items with an id, in blocks of about ``size`` bytes of text."""
    known = texts(benchmark, key="item_id").where("doc_id is not null and length(text) > 0")
    total = known.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // size))
    for b in range(blocks):
        part = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == b)
        yield [(r.doc_id, bytes(r.text)) for r in part.collect()]


FOUND = "spans binary, items array<long>"


def key_of(text: bytes | None) -> bytes:
    return hashlib.sha256(text or b"").digest()


def _searched(rows: DataFrame, block: list, width: int, hits_only: bool) -> tuple[DataFrame, Broadcast]:
    """(doc_id, n_words, key, spans, items) of every row, or (key, spans, items) of those with a hit, for one block."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(shared.value, width)
        for piece in pieces_of(batches, rows=8_000, size=16 << 20):
            ids, raw = columns_of(piece, "doc_id", "text")
            words = [words_of(t) for t in raw]
            spans, items = find_phrases(words, phrases)
            take = [i for i in range(len(raw)) if len(spans[i]) or not hits_only]
            found = [pa.array([key_of(raw[i]) for i in take], pa.binary()),
                     pa.array([spans[i].astype(np.int64).tobytes() for i in take], pa.binary()),
                     pa.array([sorted(items[i]) for i in take], pa.list_(pa.int64()))]
            names = ["key", "spans", "items"]
            if not hits_only:
                found += [pa.array(ids, pa.int64()), pa.array([len(w) for w in words], pa.int64())]
                names += ["doc_id", "n_words"]
            yield pa.RecordBatch.from_arrays(found, names=names)
    return rows.mapInArrow(run, f"key binary, {FOUND}" + ", doc_id long, n_words long" * (not hits_only)), shared


def _earlier_hits(docs: DataFrame, benchmark: DataFrame, width: int) -> tuple[list[DataFrame], list]:
    """The written hits of all blocks but the last, each searched and freed before the next is fetched; and the last block."""
    rows, tables = texts(docs), []
    blocks = benchmark_blocks(benchmark)
    block = next(blocks)
    for following in blocks:
        hits, shared = _searched(rows, block, width, True)
        tables.append(written(hits, "benchmark-hits"))
        shared.destroy()
        block = following
    return tables, block


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, the merged spans of words hit, and the ids of items that occur.

    ``benchmark`` has item_id and text. Rows without a text have no words; items without id or words are ignored, equal
    ids are one item. Null and repeated doc_ids are rows like any other; an empty benchmark hits nothing.
    """
    tables, block = _earlier_hits(docs, benchmark, width)
    found = _searched(texts(docs), block, width, False)[0]
    if not tables:
        return found.select("doc_id", "n_words", "spans", "items")
    # equal texts gave equal hits in a block, so a text has one entry for each block at most
    earlier = reduce(DataFrame.unionByName, [t.dropDuplicates(["key"]) for t in tables]).groupBy("key").agg(
        F.collect_list("spans").alias("more_spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("more_items"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, spans, items, more_spans, more_items = columns_of(
                batch, "doc_id", "n_words", "spans", "items", "more_spans", "more_items")
            total = [merged(np.frombuffer(b"".join([a, *(more or [])]), np.int64).reshape(-1, 2)).tobytes()
                     for a, more in zip(spans, more_spans)]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(total, pa.binary()),
                pa.array([sorted({*a, *(more or [])}) for a, more in zip(items, more_items)], pa.list_(pa.int64()))],
                names=["doc_id", "n_words", "spans", "items"])
    return found.join(earlier, "key", "left").mapInArrow(add, f"doc_id long, n_words long, {FOUND}")


def clean_documents(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, with all their columns; each row is judged by its own text."""
    tables, block = _earlier_hits(docs, benchmark, width)
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(shared.value, width)
        for piece in pieces_of(batches, rows=8_000, size=16 << 20):
            raw = piece.column(piece.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
            spans, _ = find_phrases([words_of(t) for t in raw], phrases)
            yield piece.filter(pa.array([not len(x) for x in spans], pa.bool_()))
    left = docs.mapInArrow(run, docs.schema)
    if not tables:
        return left
    gone = reduce(DataFrame.unionByName, [t.select(F.lower(F.hex("key")).alias("_gone")) for t in tables]).distinct()
    digest = F.sha2(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), 256)
    return left.join(gone, digest == F.col("_gone"), "left_anti")


def contamination_digest(found: DataFrame) -> DataFrame:
    """The figures of the query from spans and items."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, spans, items = columns_of(batch, "doc_id", "n_words", "spans", "items")
            hit = [int(np.diff(np.frombuffer(s, np.int64).reshape(-1, 2)).sum()) for s in spans]
            digest = [hashlib.sha256(",".join(sorted(map(str, i))).encode()).hexdigest() for i in items]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(hit, pa.int64()),
                pa.array([len(i) for i in items], pa.int64()), pa.array(digest, pa.string())],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256"])
    rows = found.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string")
    return rows.withColumn("contaminated", F.col("n_hit") > 0)


@query("op4_decontamination")
def op4_decontamination(spark, folder):
    return contamination_digest(find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")))
