"""Ranked lexical search by dense products of weight and impact tiles.

Items are taken in blocks of bounded size; a block's terms are its vocabulary. One pass over the documents gives, per
document, its length and the occurrences of the vocabulary's terms, as a written table; document counts, lengths and
document frequencies are aggregates of it.

Within a block, a tile of items has a compact vocabulary of its own terms. For a tile of documents the impacts of these
terms form a dense matrix (terms x documents), the weights another one (items x terms); their product in float64 has all
scores of the two tiles. All factors are whole numbers, and a slice of the vocabulary is so narrow that the sum of its
largest products stays below 2^53, so a product is exact; products of several slices are added as 64-bit integers.

A task keeps the best k rows of each item: only scores that beat the k-th (or equal it with a smaller id) enter, so ties
are cut by id and not by the order of tiles. The rows that tasks give are ranked in two rounds, first by (item, salt).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tabwright.llm.common import columns_of, dropped, pieces_of, table, written
from tabwright.llm.registry import query

EXACT = 2 ** 53
# Fixed values of the score: impacts have three digits after the point, lengths count half, a term saturates at 2 (m / 100).
SCALE, HALF, SLOPE = 1_000_000_000, 50, 20
IMPACT = SCALE // 1_000  # no impact reaches this
# Terms are ASCII letters and digits and everything beyond ASCII; A-Z are lower-cased.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
NO_ID = np.iinfo(np.int64).max


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLDED).split()


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces_of(batches):
        raw, = columns_of(piece, "text")
        lists = [sorted(set(terms_of(t))) for t in raw]
        offsets = pa.array(list(accumulate(map(len, lists), initial=0)), pa.int32())
        yield pa.RecordBatch.from_arrays([piece.column(piece.schema.get_field_index("item_id")), pa.ListArray.from_arrays(
            offsets, pa.array([w for x in lists for w in x], pa.binary()))], names=["item_id", "terms"])


def item_blocks(items: DataFrame, size: int) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Item ids and their terms in blocks of at most ``size`` terms, or of one item; rows of equal item_id make one item."""
    kind = items.schema["item_id"].dataType.simpleString()
    listed = items.select("item_id", F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(
        _item_terms, f"item_id {kind}, terms array<binary>")
    found = (listed.select("item_id", F.explode("terms").alias("term")).distinct()
             .groupBy("item_id").agg(F.collect_list("term").alias("terms")).orderBy("item_id"))
    ids, terms, held = [], [], 0
    for row in found.toLocalIterator():
        if ids and held + len(row.terms) > size:
            yield ids, terms
            ids, terms, held = [], [], 0
        ids.append(row.item_id)
        terms.append(sorted(map(bytes, row.terms)))
        held += len(row.terms)
    if ids:
        yield ids, terms


@dataclass
class Tile:
    """Some items of a block: their numbers, and of each the terms (numbers in the block's vocabulary)."""

    items: list[int]
    terms: list[np.ndarray]

    def slices(self, weight: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(compact vocabulary, weights of items x vocabulary) in slices whose products stay exact."""
        vocabulary = np.unique(np.concatenate(self.terms))
        narrow = max(1, min(width, int((EXACT - 1) // (IMPACT * max(1, int(weight[vocabulary].max()))))))
        for start in range(0, len(vocabulary), narrow):
            part = vocabulary[start:start + narrow]
            weights = np.zeros((len(self.items), len(part)))
            for i, terms in enumerate(self.terms):
                own = terms[(terms >= part[0]) & (terms <= part[-1])]
                weights[i, np.searchsorted(part, own)] = weight[own]
            yield part, weights


def item_tiles(terms: list[np.ndarray], items: int = 64, width: int = 2_048) -> list[Tile]:
    """Tiles of at most ``items`` items and ``width`` terms, or of one item."""
    out: list[Tile] = []
    held = 0
    for i, own in enumerate(terms):
        if not out or len(out[-1].items) == items or held + len(own) > width:
            out.append(Tile([], []))
            held = 0
        out[-1].items.append(i)
        out[-1].terms.append(own)
        held += len(own)
    return out


class Best:
    """The k best (score, doc_id) of each item so far; higher scores first, equal ones by smaller id."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.scores = [np.zeros(0, np.int64)] * items
        self.ids = [np.zeros(0, np.int64)] * items
        self.floor, self.last = np.ones(items, np.int64), np.full(items, NO_ID)  # what a row must beat, or equal

    def add(self, items: list[int], scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores``: items x documents."""
        floor = self.floor[items][:, None]
        row, column = np.nonzero((scores > floor) | (scores == floor) & (ids <= self.last[items][:, None]))
        bounds = np.searchsorted(row, np.arange(len(items) + 1))
        for r in np.flatnonzero(np.diff(bounds)).tolist():
            new, i = column[bounds[r]:bounds[r + 1]], items[r]
            s, d = np.append(self.scores[i], scores[r, new]), np.append(self.ids[i], ids[new])
            order = np.lexsort((d, -s))[:self.k]
            self.scores[i], self.ids[i] = s[order], d[order]
            if len(order) == self.k:
                self.floor[i], self.last[i] = s[order[-1]], d[order[-1]]


def tile_scores(tile: Tile, weight: np.ndarray, width: int, terms: np.ndarray, owner: np.ndarray, impact: np.ndarray,
                documents: int) -> np.ndarray:
    """items x documents; ``terms``, ``owner`` and ``impact`` are the occurrences in the tile of documents."""
    total = np.zeros((len(tile.items), documents), np.int64)
    for part, weights in tile.slices(weight, width):
        column = np.full(len(weight), -1, np.int32)
        column[part] = np.arange(len(part))
        here = column[terms]
        own = here >= 0
        impacts = np.zeros((len(part), documents))
        impacts[here[own], owner[own]] = impact[own]
        total += (weights @ impacts).astype(np.int64)
    return total


COUNTED = "doc_id long, n long, terms array<int>, occurrences array<int>"


def _count(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = {t: i for i, t in enumerate(shared.value)}
    for piece in pieces_of(batches, size=4 << 20):
        doc_ids, raw = columns_of(piece, "doc_id", "text")
        sizes, terms, occurrences, lengths = [], [], [], [0]
        for text in raw:
            words = terms_of(text)
            known = np.array([i for w in words if (i := number.get(w, -1)) >= 0], np.int32)
            own, times = np.unique(known, return_counts=True)
            sizes.append(len(words))
            terms.append(own)
            occurrences.append(times.astype(np.int32))
            lengths.append(lengths[-1] + len(own))
        offsets = pa.array(lengths, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc_ids, pa.int64()), pa.array(sizes, pa.int64()),
             pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(terms))),
             pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(occurrences)))],
            names=["doc_id", "n", "terms", "occurrences"])


def _score(shared, documents: int, total: int, k: int, width: int, rows: int,
           batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tiles, weight, items = shared.value
    best = Best(items, k)
    for piece in pieces_of(batches, rows=rows):
        ids = piece.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        n = piece.column(1).to_numpy(zero_copy_only=False)
        terms, times = (piece.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))
        owner = np.repeat(np.arange(len(ids)), np.diff(piece.column(2).offsets.to_numpy()))
        length = 100 - HALF + HALF * n * documents // total
        impact = SCALE * times.astype(np.int64) // (1_000 * times.astype(np.int64) + SLOPE * length[owner])
        for tile in tiles:
            best.add(tile.items, tile_scores(tile, weight, width, terms, owner, impact, len(ids)), ids)
    item = np.repeat(np.arange(items, dtype=np.int32), [len(s) for s in best.scores])
    found = np.concatenate(best.ids) if items else np.zeros(0, np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(item), pa.array(found, mask=found == NO_ID), pa.array(np.concatenate(best.scores), pa.int64())],
        names=["item", "doc_id", "score"])


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 50, block: int = 100_000, width: int = 2_048,
                     rows: int = 512) -> DataFrame:
    """item_id, rank, doc_id, score: of each item the ``k`` rows of ``docs`` with the highest scores above 0.

    ``block`` bounds the terms of a block of items (an item of more terms is a block by itself), ``width`` a tile's
    vocabulary, ``rows`` a tile's documents; none changes the result. Null texts have no terms. Repeated rows of ``docs``
    are ranked each, a null doc_id after all others of its score; items of equal item_id count as one with the terms of
    all, items without terms give no rows. Other columns are ignored. 50 x (length) x (documents) must stay below 2^63.
    """
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, doc_id long, score long")
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    for ids, lists in item_blocks(items, block):
        vocabulary = sorted(set().union(*lists))
        number = {t: i for i, t in enumerate(vocabulary)}
        shared = spark.sparkContext.broadcast(vocabulary)
        counted = written(plain.mapInArrow(lambda b, s=shared: _count(s, b), COUNTED).where("n > 0"), "ranking-counts")
        shared.destroy()
        documents, total = counted.agg(F.count("*"), F.sum("n")).first()
        holders = np.zeros(len(vocabulary), np.int64)
        for term, n in counted.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            holders[term] = n
        weight = np.floor(1_000 * np.log((2 * documents + 2) / (2 * holders + 1))).astype(np.int64)
        tiles = item_tiles([np.array([number[t] for t in own], np.int32) for own in lists], width=width)
        shared = spark.sparkContext.broadcast((tiles, weight, len(ids)))
        found = counted.where("size(terms) > 0").mapInArrow(
            lambda b, s=shared, d=documents, t=total: _score(s, d, t, k, width, rows, b), "item int, doc_id long, score long")
        best = written(_first(found.withColumn("salt", F.spark_partition_id() % 64), ["item", "salt"], k).drop("salt", "rank"),
                       "ranking-best")
        shared.destroy()
        dropped(counted)
        names = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {kind}")
        out = out.unionByName(best.join(F.broadcast(names), "item").select("item_id", "doc_id", "score"))
    return _first(out, ["item_id"], k).select("item_id", "rank", "doc_id", "score")


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


SQL = r"""
with d as (
    select row_number() over () as r, doc_id,
           string_split(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' ') as words
    from documents),
occurrences as (select r, doc_id, unnest(words) as term from d),
counted as (select r, doc_id, term, count(*) as tf from occurrences where term <> '' group by all),
lengths as (select r, cast(sum(tf) as bigint) as n from counted group by r),
total as (select cast(count(*) as bigint) as docs, cast(sum(n) as bigint) as len from lengths),
i as (
    select item_id,
           unnest(string_split(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' ')) as term
    from benchmark),
terms as (select distinct item_id, term from i where term <> ''),
frequencies as (select term, count(*) as df from counted group by term),
weights as (
    select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) as bigint) as w from frequencies, total),
scores as (
    select item_id, r, doc_id,
           cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // len)))) as bigint) as score
    from terms join counted using (term) join weights using (term) join lengths using (r), total
    group by item_id, r, doc_id)
select item_id, cast(rank as integer) as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0)
where rank <= 50
"""


@query("op11_ranking", SQL)
def op11_ranking(spark, folder):
    return ranked_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
