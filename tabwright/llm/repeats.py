"""Removal of repeated passages by longest previous factors.

A byte is removed if some string of ``length`` bytes over it also starts earlier. Documents follow each other by id.

Every string of that length (a window) has a key: the smallest hash of a shorter string inside it. Equal windows have
equal keys, and neighbouring windows mostly share one, so a document is a sequence of short runs of windows with one key.

1. Runs of all documents, a row each with the hash of the text they span; no text is shuffled.
2. Keys that occur once end here. Of runs with equal spans, the first stays and all later ones are wholly repeated.
3. Where different spans share a key, the windows of the first runs are looked at one by one: those whose hash occurs
   again become suffixes. They are dealt by content, sorted in suffix order, and the longest common prefixes with the
   previous and the next suffix of smaller position give the longest previous factor. At ``length`` or more it is a
   repeat.

Counting happens in part before each shuffle, also by keeping just the first of equal runs and windows in a task, so a
passage in a third of all documents puts no more than one row per task into any group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabwright.llm.common import columns_of, dropped, mixed, pieces_of, table, texts, written
from tabwright.llm.registry import query

_RANDOM = np.random.default_rng(20_240_501)
BYTE_VALUES = _RANDOM.integers(0, 2**63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
FACTOR = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(FACTOR), -1, 2**64))


class Powers:
    """Powers of the hash factor and of its inverse, as many as were needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        while len(self.up) < n:
            self.up, self.down = (np.concatenate([p, p * (p[-1:] * f)]) for p, f in ((self.up, FACTOR), (self.down, INVERSE)))


class Hashes:
    """Hashes of any substring of one text, from prefix sums."""

    def __init__(self, data: np.ndarray, powers: Powers, which: int):
        powers.grow(len(data) + 1)
        self.powers = powers
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[which][data] * powers.up[:len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.powers.down[start])


def sliding(values: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """Minimum (or what ``pick`` takes) of every ``width`` neighbours, by doubling."""
    size = 1
    while 2 * size <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return pick(values[:len(values) - rest], values[rest:]) if rest else values


def runs_of(data: np.ndarray, powers: Powers, length: int, inner: int) -> tuple[np.ndarray, ...]:
    """start, number of windows, key and span hash of each run of a text, and whether its key may occur twice in it.

    A run has at most ``length`` windows. Only where the key's string occurs twice can a run hold two equal windows.
    """
    first, second = Hashes(data, powers, 0), Hashes(data, powers, 1)
    width = length - inner + 1
    at = np.arange(len(data) - inner + 1)
    small = first.of(at, at + inner)
    keys = sliding(small, width)
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(edge, len(keys)))
    if sizes.max() > length:
        parts = -(-sizes // length)
        edge = np.repeat(edge, parts) + (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * length
        sizes = np.diff(np.append(edge, len(keys)))
    margin = np.zeros(width - 1, np.uint64)
    is_key = np.flatnonzero(small == sliding(np.concatenate([margin, keys, margin]), width, np.maximum))
    near = (small[is_key[1:]] == small[is_key[:-1]]) & (np.diff(is_key) <= length)
    steps = np.zeros(len(edge) + 1, np.int64)
    np.add.at(steps, np.searchsorted(edge, np.maximum(is_key[:-1][near] - width + 1, 0), "right") - 1, 1)
    np.add.at(steps, np.searchsorted(edge, is_key[1:][near], "right"), -1)
    return edge, sizes, keys[edge], second.of(edge, edge + sizes - 1 + length), np.cumsum(steps[:-1]) > 0


def first_of_equal(*columns: np.ndarray) -> np.ndarray:
    """Marks the first row of each group of equal leading columns; the last two columns give the order."""
    order = np.lexsort(columns[::-1])
    same = np.ones(max(0, len(order) - 1), bool)
    for c in columns[:-2]:
        same &= c[order][1:] == c[order][:-1]
    first = np.ones(len(order), bool)
    first[order[1:]] = ~same
    return first


def all_runs(docs: DataFrame, length: int, inner: int) -> DataFrame:
    """(doc_id, start, n, key, span, twice, gone): gone where the same span came earlier in the same part of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for piece in pieces_of(batches, rows=50_000):
            ids, raw = columns_of(piece, "doc_id", "text")
            found = [(d, *runs_of(np.frombuffer(t, np.uint8), powers, length, inner)) for d, t in zip(ids, raw)]
            if not found:
                continue
            doc = np.concatenate([np.full(len(f[1]), f[0], np.int64) for f in found])
            start, n, key, span, twice = (np.concatenate([f[i] for f in found]) for i in (1, 2, 3, 4, 5))
            gone = ~first_of_equal(key, span, doc, start)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(key.view(np.int64)),
                 pa.array(span.view(np.int64)), pa.array(twice), pa.array(gone)],
                names=["doc_id", "start", "n", "key", "span", "twice", "gone"])
    return docs.mapInArrow(run, "doc_id long, start int, n int, key long, span long, twice boolean, gone boolean")


def longest_previous_factors(order: np.ndarray, place: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For suffixes in sorted ``order``: the longest prefix each shares with one of smaller ``place``.

    ``common[i]`` is the common prefix of sorted suffixes i - 1 and i. One pass with a stack finds the previous and the
    next suffix of smaller place; the common prefix with either is the minimum of ``common`` between them.
    """
    n = len(order)
    longest = np.zeros(n, np.int64)
    places, shared = place[order].tolist(), common.tolist()
    stack: list[tuple[int, int]] = []  # (sorted index, common prefix with the entry below it)
    for i in range(n + 1):
        here = places[i] if i < n else -1
        low = shared[i] if 0 < i < n else 0
        while stack and places[stack[-1][0]] > here:
            j, below = stack.pop()
            longest[order[j]] = max(below, low)  # previous smaller, next smaller
            low = min(low, below)
        stack.append((i, low))
    return longest


def repeated_windows(content: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which rows of ``content`` (bytes of one length) are the content of a row with smaller (doc, start), by suffix order."""
    count, length = content.shape
    if not count:
        return np.zeros(0, bool)
    place = np.empty(count, np.int64)
    place[np.lexsort((start, doc))] = np.arange(count)
    rows = np.ascontiguousarray(content).view(f"V{length}").ravel()
    order = np.argsort(rows, kind="stable")
    differ = content[order[1:]] != content[order[:-1]]
    common = np.concatenate([[0], np.where(differ.any(1), differ.argmax(1), length)])
    return longest_previous_factors(order, place, common) >= length


def _mask(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _suffix_rows(docs: DataFrame, firsts: DataFrame, length: int) -> DataFrame:
    """Runs to look at window by window, with the text they span, dealt by (key, salt).

    A key with many spans has several salts, and a window goes to the one its content chooses. ``mask`` marks the windows
    meant. Windows that came earlier in the same part of a task are marked in ``gone`` instead (salt -1).
    """
    wanted = firsts.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "key", "salts")).alias("runs"))
    names = ["key", "salt", "doc_id", "start", "mask", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for piece in pieces_of(batches, rows=2_000, size=4 << 20):
            rows, hashes, keys = [], [], []
            for doc_id, text, runs in zip(*columns_of(piece, "doc_id", "text", "runs")):
                data = np.frombuffer(text, np.uint8)
                content = Hashes(data, powers, 1)
                for r in runs:
                    at = np.arange(r["start"], r["start"] + r["n"])
                    rows.append((doc_id, r, text[r["start"]:r["start"] + r["n"] - 1 + length]))
                    hashes.append(content.of(at, at + length))
            if not rows:
                continue
            sizes = np.array([len(h) for h in hashes])
            doc, start, key = (np.repeat(np.array(x, np.int64), sizes) for x in (
                [r[0] for r in rows], [r[1]["start"] for r in rows], [r[1]["key"] for r in rows]))
            ends = np.cumsum(sizes)
            flat = np.concatenate(hashes)
            start = start + np.arange(len(flat)) - np.repeat(ends - sizes, sizes)
            first = first_of_equal(key, flat, doc, start)
            out = []
            for (doc_id, r, data), a, b in zip(rows, (ends - sizes).tolist(), ends.tolist()):
                own = first[a:b]
                if not own.all():
                    out.append((r["key"], -1, doc_id, r["start"], _mask(~own), b""))
                salt = (flat[a:b] % np.uint64(r["salts"])).astype(np.int64)
                out += [(r["key"], s, doc_id, r["start"], _mask(own & (salt == s)), data) for s in np.unique(salt[own]).tolist()]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            for at in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[at:at + 20_000]), kinds)], names=names)
    joined = docs.join(wanted, "doc_id").select("doc_id", "text", "runs")
    return joined.mapInArrow(run, "key long, salt int, doc_id long, start int, mask binary, data binary")


def _windows_gone(suffixes: DataFrame, length: int, most: int = 400_000) -> DataFrame:
    """(doc_id, start, n) of repeated windows among rows of equal (key, salt); about ``most`` windows are sorted together."""
    def solve(rows: list[tuple]) -> pa.RecordBatch:
        powers = Powers()
        doc, start, content = [], [], []
        for _, _, d, s, mask, data in rows:
            at = np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8)))
            doc.append(np.full(len(at), d, np.int64))
            start.append(at + s)
            content.append((np.frombuffer(data, np.uint8), at))
        doc, start = np.concatenate(doc), np.concatenate(start)
        hashes = np.concatenate([Hashes(data, powers, 1).of(at, at + length) for data, at in content])
        _, where, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        again = counts[where] > 1  # the content of all others is there once
        views = np.concatenate([np.lib.stride_tricks.sliding_window_view(data, length)[at[keep]] for (data, at), keep in zip(
            content, np.split(again, np.cumsum([len(at) for _, at in content])[:-1]))])
        doc, start = doc[again], start[again]
        gone = repeated_windows(views, doc, start)
        doc, start = doc[gone], start[gone]
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        fresh = np.ones(len(doc), bool)  # neighbouring windows leave as one row
        fresh[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
        edge = np.flatnonzero(fresh)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[edge]), pa.array(start[edge].astype(np.int32)),
             pa.array(np.diff(np.append(edge, len(doc))).astype(np.int32))], names=["doc_id", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*columns_of(batch, "key", "salt", "doc_id", "start", "mask", "data")):
                if size >= most and row[:2] != last:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5]) - length + 1
                last = row[:2]
        if held:
            yield solve(held)
    dealt = suffixes.repartition("key", "salt").sortWithinPartitions("key", "salt")
    return dealt.mapInArrow(run, "doc_id long, start int, n int")


def find_repeats(docs: DataFrame, length: int = 100, inner: int = 40, most_spans: int = 1_000) -> DataFrame:
    """(doc_id, start, n): n windows from byte ``start`` on that also start earlier; ``docs`` has doc_id and text as bytes."""
    docs = docs.where(F.col("doc_id").isNotNull() & (F.length("text") >= length))
    runs = written(all_runs(docs, length, inner), "repeat-runs")
    open_runs = runs.where("not gone").drop("gone")
    shared = open_runs.groupBy("key").agg(F.count("*").alias("c"), F.bool_or("twice").alias("twice")).where("c > 1 or twice").select("key")
    shared_runs = written(open_runs.join(shared, "key"), "repeat-shared")
    columns = ["doc_id", "start", "n"]
    gone = written(runs.where("gone").select(*columns), "repeat-gone")
    dropped(runs)
    firsts = shared_runs.groupBy("key", "span").agg(F.min(F.struct("doc_id", "start", "n")).alias("first"), F.count("*").alias("c"),
                                                F.bool_or("twice").alias("twice"))
    firsts = written(firsts, "repeat-firsts")
    later = shared_runs.join(firsts.where("c > 1").select("key", "span", "first"), ["key", "span"]).where(
        (F.col("doc_id") != F.col("first.doc_id")) | (F.col("start") != F.col("first.start")))
    several = firsts.groupBy("key").agg(F.count("*").alias("spans"), F.bool_or("twice").alias("twice")).where("spans > 1 or twice").select(
        "key", F.ceil(F.col("spans") / most_spans).cast("int").alias("salts"))
    looked_at = firsts.join(several, "key").select("first.*", "key", "salts")
    suffixes = written(_suffix_rows(docs, looked_at, length), "repeat-suffixes")
    marked = suffixes.where("salt = -1").select("doc_id", "start", "mask")
    windows = _windows_gone(suffixes.where("salt >= 0"), length)

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, start, mask in zip(*columns_of(batch, "doc_id", "start", "mask")):
                flags = np.unpackbits(np.frombuffer(mask, np.uint8))
                edges = np.flatnonzero(np.diff(np.concatenate([[0], flags, [0]]).astype(np.int8))).reshape(-1, 2)
                out += [(doc_id, start + a, b - a) for a, b in edges.tolist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
                    zip(*out), (pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "start", "n"])
    return gone.union(later.select(*columns)).union(windows).union(
        marked.mapInArrow(spelled, "doc_id long, start int, n int"))


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs`` (doc_id, text), and the bytes kept.

    A null text is an empty one. A row without id neither loses bytes nor costs others any. Of rows with one id, the text
    of smallest hash is the document, and all rows with that text share its result; other texts under the id are left as
    they are and count for nobody. Other columns are ignored.
    """
    own = texts(docs).withColumn("text", F.coalesce("text", F.lit(b""))).withColumn("h", F.xxhash64("text"))
    chosen = own.where("doc_id is not null").groupBy("doc_id").agg(F.min("h").alias("main"), F.max("h").alias("other"))
    doubled = written(chosen.where("main <> other").select("doc_id", "main"), "repeat-ids")
    if not doubled.isEmpty():
        own = own.join(doubled, "doc_id", "left").withColumn("own", F.coalesce(F.col("main") == F.col("h"), F.lit(True)))
    else:
        own = own.withColumn("own", F.lit(True))
    taking_part = own.where("own").select("doc_id", "text")
    if not doubled.isEmpty():
        taking_part = taking_part.join(doubled, "doc_id", "left_anti").union(
            taking_part.join(doubled, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    removed = find_repeats(taking_part, length).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    joined = own.join(removed, "doc_id", "left").select(
        "doc_id", "text", F.when(F.col("own"), F.col("runs.start")).alias("starts"), F.col("runs.n").alias("sizes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces_of(batches):
            rows = []
            for doc_id, text, starts, sizes in zip(*columns_of(piece, "doc_id", "text", "starts", "sizes")):
                steps = np.zeros(len(text) + 1, np.int32)
                if starts:
                    at = np.array(starts, np.int64)
                    np.add.at(steps, at, 1)
                    np.add.at(steps, at + np.array(sizes, np.int64) - 1 + length, -1)
                gone = np.cumsum(steps[:-1]) > 0
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
                rows.append((doc_id, len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


@query("op8_repeats")
def op8_repeats(spark, folder):
    return remove_repeats(table(spark, folder, "documents")).drop("kept")
