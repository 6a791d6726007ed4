"""Near-duplicate documents by HyperMinHash.

A document's 5-word shingles are hashed once. The upper bits of a hash choose one of 128 buckets; of the smallest
remainder in a bucket only its number of leading zeros and ten mantissa bits are kept, 16 bits in all. Four registers
form a band; documents that share one of the 32 bands are candidates (a pair at similarity 0.75 is missed with
probability below 6e-6). The registers also estimate the similarity, corrected for registers that agree by chance;
pairs that are clearly below the threshold go no further. The rest are confirmed on their full shingle sets.

Documents of one shingle set are one node. Within a band, members are first compared with its smallest member only, and
links are contracted to components. Only bands whose members are still in several components are looked at again: there
the members outside the first member's component meet all members in blocks of bounded size, by their registers. Members
with a plausible partner then meet once more with their full sets, and each block gives a spanning forest of its confirmed
links, so that a large family of texts close to the threshold makes rows in proportion to its members, not its pairs. No
pair within a component needs a look, since it could not change the result, and no bucket is cut short.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tabwright.llm.common import LOWER, columns_of, mixed, pieces_of, table, texts, written
from tabwright.llm.components import connected_components
from tabwright.llm.registry import query

BUCKET_BITS, MANTISSA_BITS, ROWS = 7, 10, 4
BUCKETS = 1 << BUCKET_BITS
REST = 64 - BUCKET_BITS


class WordHashes(dict):
    """64-bit hash of a word, kept once computed."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes | None, known: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``width`` words; all words as one if there are fewer."""
    if len(known) > 500_000:
        known.clear()
    words = (text or b"").translate(LOWER).split()  # bytes split at space and \\x09-\\x0D, just as the contract's words
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(width, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - k + 1 + i])
    return np.unique(out)


def registers(hashes: np.ndarray) -> np.ndarray:
    """128 registers of 16 bits; 0 stands for an empty bucket."""
    out = np.zeros(BUCKETS, np.uint16)
    if len(hashes):
        bucket = (hashes >> np.uint64(REST)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        rest = (hashes[first] & np.uint64((1 << REST) - 1)).astype(np.float64)
        fraction, exponent = np.frexp(rest)
        mantissa = np.minimum(((fraction * 2 - 1) * (1 << MANTISSA_BITS)).astype(np.int64), (1 << MANTISSA_BITS) - 1)
        mantissa[rest == 0] = 0
        out[bucket[first]] = ((REST - exponent) << MANTISSA_BITS) + mantissa + 1
    return out


def chance_agreement(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Share of registers in which unrelated sets of n and m elements agree: both minima in one cell of the registers."""
    power = np.arange(1, 40)[None, :]
    def within(size):  # probability that the minimum lies between 2^-p and 2^-(p-1)
        size = (np.asarray(size, float) / BUCKETS)[:, None]
        return np.exp(-size * 2.0 ** -power) - np.exp(-size * 2.0 ** (1 - power))
    return (within(n) * within(m)).sum(1) / (1 << MANTISSA_BITS)


def estimates(a: np.ndarray, b: np.ndarray, by_chance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarity of register rows, corrected for chance agreement, and the number of buckets it rests on."""
    used = np.maximum(((a > 0) | (b > 0)).sum(-1), 1)
    agree = ((a == b) & (a > 0)).sum(-1)
    chance = by_chance * BUCKETS / used
    return np.clip((agree / used - chance) / np.maximum(1 - chance, 1e-9), 0, 1), used


def plausible(estimate: np.ndarray, used: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs whose set sizes allow the threshold and whose estimate is within five standard errors of it.

    The buckets used are a sample of the union without repetition, hence the correction for a finite population.
    """
    union = np.maximum((n + m) / (1 + threshold), used)
    error = np.sqrt(threshold * (1 - threshold) / used * (1 - used / (union + 1)))
    return (np.minimum(n, m) >= threshold * np.maximum(n, m)) & (estimate >= threshold - 5 * error - 1 / used)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n, key, bands) per row: set size, digest of the set, registers as 32 numbers (null for an empty set)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for piece in pieces_of(batches):
            ids, raw = columns_of(piece, "doc_id", "text")
            n, keys, bands = [], [], []
            for text in raw:
                found = shingles(text, known)
                n.append(len(found))
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                bands.append(registers(found).view(np.int64).tolist() if len(found) else None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.binary()),
                                              pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n", "key", "bands"])
    return texts(docs).mapInArrow(run, "doc_id long, n long, key binary, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(key, hashes) per row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for piece in pieces_of(batches, size=4 << 20):
            sets = [shingles(t, known) for t in columns_of(piece, "text")[0]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                 pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "hashes"])
    return texts(docs).mapInArrow(run, "key binary, hashes binary")


def _registers_of(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64).view(np.uint16).reshape(len(column), BUCKETS)


def _plausible_pairs(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that pass the estimate."""
    own = nodes.select("node", "n", "bands")
    left = own.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bands").alias("ra"))
    right = own.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bands").alias("rb"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                n, m = f.na.to_numpy(), f.nb.to_numpy()
                keep = plausible(*estimates(_registers_of(f.ra), _registers_of(f.rb), chance_agreement(n, m)), n, m, threshold)
                yield f.loc[keep, ["a", "b"]]
    return pairs.join(left, "a").join(right, "b").mapInPandas(run, "a long, b long")


def _sets_of(ends: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, hashes) of the nodes in ``ends``: sets are made again for these only, few beside the input."""
    wanted = ends.join(nodes.select("node", "key"), "node")
    chosen = docs.join(wanted.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    sets = shingle_sets(chosen).join(wanted, "key").groupBy("node").agg(F.any_value("hashes").alias("hashes"))
    return written(sets, "dedup-sets")


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets have 100 * intersection >= percent * union."""
    sets = _sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), nodes, docs)
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b").join(
        sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces_of(batches):
            keep = []
            for x, y in zip(*columns_of(piece, "ha", "hb")):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                shared = int((y[at] == x).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield piece.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return both.select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long")


def _dealt(members: DataFrame, load: Column, block: int) -> DataFrame:
    """(band, value, i, j, node, component, left) for bands with members in several components.

    In each band the members outside the first member's component are dealt into blocks of about ``block`` units of
    ``load``, and so are all members. Cell (i, j) holds outer block i as left rows and block j of all as right rows.
    """
    band = ["band", "value"]
    parts = members.groupBy(*band, "component").agg(F.sum(load).alias("load"), F.min("node").alias("first"))
    sizes = parts.groupBy(*band).agg(F.sum("load").alias("size"), F.min(F.struct("first", "component", "load")).alias("main"),
                                     F.count("*").alias("components")).where("components > 1").select(
        *band, "size", F.col("main.component").alias("main"), (F.col("size") - F.col("main.load")).alias("outer_size"))
    def blocks(size):
        return F.ceil(F.col(size) / block).cast("int")
    def own(size):
        return F.pmod(F.xxhash64("node", F.lit(size)), blocks(size)).cast("int")
    def cells(of, i, j, left):
        return F.transform(F.sequence(F.lit(0), blocks(of) - 1), lambda k: F.struct(
            (k if i is None else i).alias("i"), (k if j is None else j).alias("j"), F.lit(left).alias("left")))
    right = cells("outer_size", None, own("size"), False)
    both = F.concat(cells("size", own("outer_size"), None, True), right)
    rows = members.join(sizes, band).select(*band, "node", "component", F.explode(
        F.when(F.col("component") != F.col("main"), both).otherwise(right)).alias("cell"))
    return rows.select(*band, "node", "component", "cell.*")


def _other_pairs(left: np.ndarray, node: np.ndarray, component: np.ndarray, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of left and right rows in different components, about ``at_once`` at a time.

    Two outer members meet in both orders, in this cell or another; the order of ascending nodes counts.
    """
    x, y = np.flatnonzero(left), np.flatnonzero(~left)
    outer = np.isin(component[y], component[x])  # a component with left rows here is an outer one
    step = max(1, at_once // max(len(y), 1))
    for start in range(0, len(x), step):
        some = x[start:start + step]
        good = (component[some][:, None] != component[y]) & (~outer | (node[some][:, None] < node[y]))
        i, j = np.nonzero(good)
        yield some[i], y[j]


def _with_plausible_partner(cells: DataFrame, placed: DataFrame, threshold: float) -> DataFrame:
    """(band, value, node) for members with a plausible partner in another component; a pair counts in its first common band."""
    def run(t: pa.Table) -> pa.Table:
        node, component, n, left = (t[c].to_numpy() for c in ("node", "component", "n", "left"))
        wide = np.ascontiguousarray(t["bands"].combine_chunks().flatten().to_numpy()).reshape(len(node), -1)
        rows, band = wide.view(np.uint16), t["band"][0].as_py()
        marked = np.zeros(len(node), bool)
        for x, y in _other_pairs(left.astype(bool), node, component, 8_192):
            close = np.minimum(n[x], n[y]) >= threshold * np.maximum(n[x], n[y])
            x, y = x[close], y[close]
            first = ~((wide[x, :band] == wide[y, :band]) & (wide[x, :band] != 0)).any(1)
            x, y = x[first], y[first]
            if len(x):
                keep = plausible(*estimates(rows[x], rows[y], chance_agreement(n[x], n[y])), n[x], n[y], threshold)
                marked[x[keep]] = marked[y[keep]] = True
        return t.select(["band", "value", "node"]).filter(pa.array(marked))
    rows = cells.join(placed.select("node", "n", "bands"), "node")
    return rows.groupBy("band", "value", "i", "j").applyInArrow(run, "band int, value long, node long").distinct()


def _confirmed_across(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components, confirmed on full sets: in each cell a spanning forest of them, no more rows than members."""
    def run(t: pa.Table) -> pa.Table:
        node, component, left = (t[c].to_numpy() for c in ("node", "component", "left"))
        own = [np.frombuffer(h, np.uint64) for h in t["hashes"].to_pylist()]
        size, left = np.array([len(h) for h in own]), left.astype(bool)
        right = np.flatnonzero(~left)
        # postings of the right rows: sorted hashes with the rows that hold them
        hashes = np.concatenate([own[k] for k in right] or [np.zeros(0, np.uint64)])
        holder = np.repeat(np.arange(len(right)), size[right])
        order = np.argsort(hashes, kind="stable")
        hashes, holder = hashes[order], holder[order]
        parent, out = {}, []
        def root(c):
            while (up := parent.setdefault(c, c)) != c:
                parent[c] = c = parent[up]
            return c
        for k in np.flatnonzero(left):
            start, end = np.searchsorted(hashes, own[k], "left"), np.searchsorted(hashes, own[k], "right")
            many = end - start
            at = np.repeat(start - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            shared = np.bincount(holder[at], minlength=len(right))
            linked = (100 * shared >= percent * (size[k] + size[right] - shared)) & (component[right] != component[k])
            for m in right[linked].tolist():
                c, d = root(component[k]), root(component[m])
                if c != d:
                    parent[d] = c
                    out.append((min(node[k], node[m]), max(node[k], node[m])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})
    return cells.join(sets, "node").groupBy("band", "value", "i", "j").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 75, block: int = 4_096) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text).

    Rows of one doc_id are one document. A row without id is linked with nothing, has no component and is kept; so do
    rows without words, apart from those of the same id. Other columns are ignored.
    """
    threshold = percent / 100
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(signatures(docs), "dedup-signatures")
    linked = rows.where("key is not null and doc_id is not null")
    nodes = written(linked.groupBy("key").agg(F.min("doc_id").alias("node"), F.any_value("n").alias("n"),
                                              F.any_value("bands").alias("bands")), "dedup-nodes")
    bands = nodes.select("node", F.posexplode("bands").alias("band", "value")).where("value <> 0")
    hubs = bands.groupBy("band", "value").agg(F.min("node").alias("a"), F.count("*").alias("size")).where("size > 1")
    shared = written(hubs.join(bands, ["band", "value"]), "dedup-shared")
    near = shared.where("a < node").select("a", F.col("node").alias("b")).distinct()
    pairs = written(_plausible_pairs(near, nodes, threshold), "dedup-pairs")
    links = written(_confirmed(pairs, nodes, docs, percent), "dedup-links")
    # rows of one id with different texts
    same = linked.groupBy("doc_id").agg(F.min("key").alias("k"), F.max("key").alias("l")).where("k <> l").select("doc_id").join(
        linked.select("key", "doc_id").distinct().join(nodes.select("key", "node"), "key"), "doc_id").select(
        F.col("doc_id").alias("a"), F.col("node").alias("b"))
    parts = connected_components(links.union(same))

    def with_component(df: DataFrame) -> DataFrame:
        return df.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = written(with_component(nodes.select("node", "n", "bands")), "dedup-placed")
    # bands of several components; two members have met already
    members = shared.where("size > 2").select("band", "value", "node").join(placed.select("node", "component"), "node")
    marked = written(_with_plausible_partner(_dealt(members, F.lit(1), block), placed, threshold), "dedup-marked")
    if not marked.isEmpty():
        sets = _sets_of(marked.select("node").distinct(), nodes, docs)
        members = marked.join(placed.select("node", "n", "component"), "node")
        found = _confirmed_across(_dealt(members, 1 + F.col("n") / 512, block), sets, percent)
        parts = connected_components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found))
    place = with_component(nodes.select("key", "node")).select("key", "component")
    out = rows.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")).join(place, "key", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


@query("op1_near_dedup")
def op1_near_dedup(spark, folder):
    return near_duplicates(table(spark, folder, "documents"))
