"""Periodic runs of words, solved in tiles by period octave.

A run of smallest period q is a maximal stretch of words with that period, here of at least max(6, 4 q) words.

1. *Tiles.* Octave k holds the periods 2^k ... 2^(k+1) - 1. Boundaries lie 2^(k+1) words apart, so a run of the octave has
   a boundary b near its start with s[b + i] = s[b + p + i] for more than p words. Hashes of blocks of 2^k words, doubled
   from octave to octave, leave out the boundaries where no period of the octave can hold that (equal blocks have equal
   hashes, so none is lost), and so does the reach of a shorter period found before: then the stretch is a power of a
   shorter word. The rest is exploded into overlapping tiles, rows of their own that are dealt out over the cluster.
2. *Fragments.* In a tile, the Z-functions at a boundary, forward and backward, give for every period of the octave the
   stretch around the boundary as far as the tile goes. Powers of a shorter word are left to that word's octave.
3. *Stitching.* Fragments are shuffled by (document, period). Two that share at least a period of words are parts of one
   stretch; maximal stretches that are long enough are the runs. Equal stretches keep the smallest period.

Documents without a tile have no run and are finished in the first step; the words of the others are joined to their runs.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tabwright.llm.common import columns_of, mixed, pieces_of, table, texts, written
from tabwright.llm.registry import query

LEAST, POWERS = 6, 4  # a run has at least max(LEAST, POWERS * period) words
CORE = 64  # boundaries of small octaves share a tile of about so many words
TILED = ("key long, doc_id long, collapsed_sha256 string, text binary, "
         "octave int, first int, size int, boundaries binary, words binary")
Edit = Callable[[int | None, list[bytes]], list[bytes]]


def _reached(words: np.ndarray, at: np.ndarray, period: int, end: int) -> np.ndarray:
    """Past-the-end position of the stretch of ``period`` that starts at each of ``at`` (ascending)."""
    part = words[at[0]:end + period]
    differ = np.append(np.flatnonzero(part[period:] != part[:-period]), len(part) - period)
    return at[0] + differ[np.searchsorted(differ, at - at[0])] + period


def tiles(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, int, int]]:
    """(document, octave, first word, boundaries, from, to) of all tiles; from and to are positions in ``words``.

    ``words`` holds documents in order of falling size, each followed by a number that occurs once, and at the end at
    least twice the largest size of such numbers. A boundary is relative to the tile.
    """
    ends = starts + sizes
    hashes = mixed(words.astype(np.uint64))
    reach = np.zeros(len(words), np.int64)
    octave = 0
    while (n := int((sizes >= max(LEAST, POWERS << octave)).sum())):
        low, gap, stop = 1 << octave, 2 << octave, int(ends[n - 1]) + 1
        at = np.arange(0, stop, gap)
        after = np.lib.stride_tricks.sliding_window_view(hashes, low)[at + low]
        row, column = np.nonzero(after == hashes[at][:, None])
        here, period = at[row], column + low
        least = np.maximum(LEAST, POWERS * period) - gap + 1 - period  # words that must repeat after the boundary
        for j in (1, 2, 3):
            offset = np.minimum(j * low, least - low)
            same = hashes[here + offset] == hashes[here + offset + period]
            here, period, least = here[same], period[same], least[same]
        primitive = reach[here] < here + 2 * period
        here, period = here[primitive], period[primitive]
        if len(here):
            owner = np.searchsorted(starts[:n], here, "right") - 1
            if n > 0 and sizes[0] >= POWERS * gap:  # larger octaves will ask how far these go
                pair = np.lexsort((here, period, owner))
                cut = np.flatnonzero((np.diff(owner[pair]) != 0) | (np.diff(period[pair]) != 0)) + 1
                for group in np.split(pair, cut):
                    found = _reached(words, here[group], int(period[group[0]]), int(ends[owner[group[0]]]))
                    reach[here[group]] = np.maximum(reach[here[group]], found)
            here, owner = (x[np.concatenate([[True], np.diff(here) != 0])] for x in (here, owner))
            core = (here - starts[owner]) // max(CORE, gap)
            cut = np.flatnonzero((np.diff(owner) != 0) | (np.diff(core) != 0)) + 1
            for group in np.split(np.arange(len(here)), cut):
                d, b = int(owner[group[0]]), here[group]
                begin = max(int(starts[d]), int(b[0]) - gap)
                yield d, octave, begin - int(starts[d]), b - begin, begin, min(int(ends[d]), int(b[-1]) + 4 * gap)
        hashes = mixed(hashes[:-low] * np.uint64(0x9E3779B97F4A7C15) + hashes[low:])
        octave += 1


def z_function(s: list[int]) -> list[int]:
    """For each position, how many items from there on equal those from the start."""
    z, left, right, n = [0] * len(s), 0, 0, len(s)
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    if n:
        z[0] = n
    return z


def fragments(s: list[int], b: int, octave: int, first: int, size: int) -> Iterator[tuple[int, int, int]]:
    """(period, start, end) of the stretches around boundary ``b`` of a tile; positions in the document.

    Given are those that are long enough or touch the edge of what the boundary sees, inside the document.
    """
    low, gap = 1 << octave, 2 << octave
    end = min(len(s), b + 4 * gap)
    seen = min(b, gap)
    forward = z_function(s[b:end])
    back = s[b - seen:min(end, b + gap)][::-1]
    backward = z_function([*s[b - seen:b][::-1], -1, *back])
    for period in range(low, min(gap, end - b)):
        right = forward[period]
        left = min(seen, backward[seen + 1 + len(back) - seen - period])
        start, stop = first + b - left, first + b + period + right
        cut = left == seen and start > 0 or first + end == stop < size
        if cut or stop - start >= max(LEAST, POWERS * period):
            if not any(period % q == 0 and forward[q] >= period - q for q in range(1, period // 2 + 1)):
                yield period, start, stop


def _split(edit: Edit | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and their tiles, as rows of one table."""
    key = TaskContext.get().partitionId() << 33
    names = [f.split()[0] for f in TILED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    for piece in pieces_of(batches, rows=4_000, size=2 << 20):
        doc_ids, raw = columns_of(piece, "doc_id", "text")
        lists = [(t or b"").split() for t in raw]
        if edit:
            lists = [edit(i, w) for i, w in zip(doc_ids, lists)]
        order = sorted(range(len(lists)), key=lambda i: -len(lists[i]))
        numbers: dict[bytes, int] = {}
        sizes = np.array([len(lists[i]) for i in order], np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        words = -np.arange(1, int((sizes + 1).sum()) + 4 * int(sizes[0]) + 66, dtype=np.int64)
        for i, start in zip(order, starts.tolist()):
            words[start:start + len(lists[i])] = [numbers.setdefault(w, len(numbers)) for w in lists[i]]
        out, tiled = [], set()
        for d, octave, first, boundaries, begin, end in tiles(words, starts, sizes):
            tiled.add(d)
            out.append((key + d, None, None, None, octave, first, int(sizes[d]), boundaries.astype(np.int32).tobytes(),
                        words[begin:end].astype(np.int32).tobytes()))
        for d, i in enumerate(order):
            text = b" ".join(lists[i])
            done = None if d in tiled else hashlib.sha256(text).hexdigest()
            out.append((key + d, doc_ids[i], done, text if d in tiled else None, None, None, None, None, None))
        key += len(order)
        for at in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at:at + 10_000]), kinds)], names=names)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "octave", "first", "size", "boundaries", "words"]
    for piece in pieces_of(batches, rows=2_000, size=4 << 20):
        out: list[tuple[int, int, int, int]] = []
        for key, octave, first, size, boundaries, words in zip(*columns_of(piece, *names)):
            s = np.frombuffer(words, np.int32).tolist()
            for b in np.frombuffer(boundaries, np.int32).tolist():
                out += [(key, *f) for f in fragments(s, b, octave, first, size)]
        arrays = np.array(sorted(set(out)), np.int64).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([pa.array(arrays[:, i]) for i in range(4)], names=["key", "period", "start", "stop"])


def stitched(parts: DataFrame) -> DataFrame:
    """(key, start, stop, period) of the runs that fragments (key, period, start, stop) make up."""
    order = Window.partitionBy("key", "period").orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = (before.isNull() | (F.col("start") > before - F.col("period"))).cast("long")
    whole = (parts.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order))
             .groupBy("key", "period", "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
             .where(F.col("stop") - F.col("start") >= F.greatest(F.lit(LEAST), POWERS * F.col("period"))))
    return whole.groupBy("key", "start", "stop").agg(F.min("period").alias("period"))


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text without the words that a run holds after its first period."""
    for piece in pieces_of(batches, rows=2_000, size=8 << 20):
        doc_ids, raw, runs = columns_of(piece, "doc_id", "text", "runs")
        collapsed = []
        for text, found in zip(raw, runs):
            words = text.split(b" ")
            keep = np.ones(len(words), bool)
            for r in found or ():
                keep[r["start"] + r["period"]:r["start"] + r["length"]] = False
            collapsed.append(b" ".join([w for w, k in zip(words, keep.tolist()) if k]))
        yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), piece.column(piece.schema.get_field_index("runs")),
                                          pa.array(collapsed, pa.binary())], names=["doc_id", "runs", "collapsed"])


RUN = "array<struct<start:long,period:long,length:long>>"


def find_runs(docs: DataFrame, edit: Edit | None = None) -> DataFrame:
    """doc_id, runs (ordered by start, then period), collapsed text or collapsed_sha256, for every row of ``docs``.

    ``edit`` may change the words of a document first. Documents without runs come with a null ``collapsed`` and the hash
    of their words joined by one space; the others have both. A null or empty text has no words and no runs. Null and
    repeated doc_ids are rows like any other; other columns are ignored. A document's runs are held together when its
    row is made; they are fewer than its words.
    """
    split = written(texts(docs).mapInArrow(lambda b: _split(edit, b), TILED), "runs-tiles")
    tiled = split.where("octave is not null").select("key", "octave", "first", "size", "boundaries", "words")
    parts = tiled.repartition("key", "octave", "first").mapInArrow(_solve, "key long, period long, start long, stop long")
    runs = (stitched(parts).groupBy("key")
            .agg(F.sort_array(F.collect_list(F.struct("start", "period", (F.col("stop") - F.col("start")).alias("length"))))
                 .cast(RUN).alias("runs")))
    whole = split.where("octave is null")
    open_ = whole.where("text is not null").select("key", "doc_id", "text").join(runs, "key", "left")
    solved = (open_.select("doc_id", "text", "runs")
              .mapInArrow(_collapse, f"doc_id long, runs {RUN}, collapsed binary")
              .withColumn("collapsed_sha256", F.sha2("collapsed", 256)).withColumn("collapsed", F.col("collapsed").cast("string")))
    plain = whole.where("text is null").select("doc_id", F.array().cast(RUN).alias("runs"),
                                               F.lit(None).cast("string").alias("collapsed"), "collapsed_sha256")
    return solved.unionByName(plain).withColumn("runs", F.coalesce("runs", F.array().cast(RUN)))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's repetition: the words from a on become copies of the p words there, in a tenth of the documents."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


@query("op12_runs")
def op12_runs(spark, folder):
    found = find_runs(table(spark, folder, "documents"), planted)
    best = F.element_at(F.sort_array(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"),
                                                               r["period"].cast("string")), F.lit("\n")))
    return (found.withColumn("best", F.when(F.size("runs") > 0, best))
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
                    (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"),
                    F.expr("1000 * -best.less div best.period").alias("exponent_milli"),
                    F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), "collapsed_sha256"))
