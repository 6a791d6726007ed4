"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. The vector of a letter n-gram binds (multiplies)
the vectors of its letters, each permuted by its place (rolled). A document's vector bundles (adds) those of all its
n-grams, word edges included; a language's prototype bundles documents of that language, each at length 1. The
prediction is the prototype of largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tabwright.llm.common import columns_of, pieces_of, table, texts
from tabwright.llm.registry import query

EDGE = 0  # stands for every stretch without letters


class Profiles:
    """Letter and n-gram vectors of one dimension."""

    def __init__(self, size: int = 1_024, gram: int = 3):
        self.size, self.gram = size, gram
        self.letters: dict[int, np.ndarray] = {}
        self.alpha: dict[int, bool] = {}

    def _letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            bits = np.random.default_rng(point + 1).integers(0, 2, self.size, np.int8)
            self.letters[point] = (2 * bits - 1).astype(np.int8)
        return self.letters[point]

    def _symbols(self, text: str) -> np.ndarray:
        """Lower-case letters, with one EDGE for each stretch of anything else; empty without letters."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        kinds, where = np.unique(points, return_inverse=True)
        for p in kinds.tolist():
            if p not in self.alpha:
                self.alpha[p] = chr(p).isalpha()
        letter = np.array([self.alpha[p] for p in kinds.tolist()], bool)[where] if len(points) else np.zeros(0, bool)
        if not letter.any():
            return np.zeros(0, np.int64)
        symbols = np.concatenate([[EDGE], np.where(letter, points, EDGE), [EDGE]]).astype(np.int64)
        return symbols[np.concatenate([[True], (symbols[1:] != EDGE) | (symbols[:-1] != EDGE)])]

    def _vectors(self, grams: np.ndarray) -> np.ndarray:
        out = np.ones((len(grams), self.size), np.int8)
        for place in range(self.gram):
            points, where = np.unique((grams >> (21 * place)) & 0x1FFFFF, return_inverse=True)
            known = np.stack([np.roll(self._letter(p), place) for p in points.tolist()])
            out *= known[where]
        return out.astype(np.float32)

    def bundle(self, texts_: list[str]) -> np.ndarray:
        """One vector per text, of length 1; zero for a text without letters."""
        counted = []
        for text in texts_:
            s = self._symbols(text)
            n = max(0, len(s) - self.gram + 1)
            grams = sum((s[i:i + n] << (21 * i) for i in range(self.gram)), np.zeros(n, np.int64))
            counted.append(np.unique(grams, return_counts=True))
        every = np.unique(np.concatenate([g for g, _ in counted] or [np.zeros(0, np.int64)]))
        out = np.zeros((len(texts_), self.size), np.float32)
        for start in range(0, len(every), 20_000):
            part = every[start:start + 20_000]
            vectors = self._vectors(part)
            for row, (grams, counts) in zip(out, counted):
                at = np.searchsorted(grams, [part[0], part[-1] + 1])
                if at[0] < at[1]:
                    chosen = slice(*at)
                    row += np.sqrt(counts[chosen]).astype(np.float32) @ vectors[np.searchsorted(part, grams[chosen])]
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.maximum(length, 1e-12)


def learn_languages(docs: DataFrame, per_language: int = 1_000, size: int = 1_024, gram: int = 3) -> dict[str, np.ndarray]:
    """A prototype per language, from at most ``per_language`` of its documents, those of smallest id hash.

    The rows to learn from are chosen on ids alone; then only their texts are read. Rows with a null id, text or lang
    are left out. The result has one vector per language.
    """
    usable = docs.where("doc_id is not null and text is not null and lang is not null")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = usable.select("doc_id", "lang").withColumn("_place", F.row_number().over(order)).where(
        F.col("_place") <= per_language).select("doc_id", "lang")
    learnt = usable.join(F.broadcast(chosen.distinct()), ["doc_id", "lang"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, sums = Profiles(size, gram), {}
        for piece in pieces_of(batches, rows=500, size=2 << 20):
            langs, raw = columns_of(piece, "lang", "text")
            for lang, vector in zip(langs, profiles.bundle([t.decode("utf-8", "replace") for t in raw])):
                sums[lang] = sums.get(lang, 0) + vector.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()],
                                                                            pa.list_(pa.float64()))], names=["lang", "v"])
    parts = texts(learnt, "lang").mapInArrow(run, "lang string, v array<double>")
    summed = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    vectors = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    found = {r.lang: np.array([p.x for p in r.v]) for r in vectors.collect()}
    return {k: v / max(np.linalg.norm(v), 1e-12) for k, v in sorted(found.items())}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], size: int = 1_024, gram: int = 3) -> DataFrame:
    """doc_id, lang_pred, score for every row; ``und`` and 0 where the text is null or has no letter.

    The score is the cosine, cut at 0. Ties go to the language first in the alphabet. Without any language to choose
    from, every row is ``und``. Null and repeated doc_ids are rows like any other.
    """
    names = list(prototypes)
    matrix = np.stack([prototypes[n] for n in names]).astype(np.float32) if names else np.zeros((1, size), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(size, gram)
        for piece in pieces_of(batches, rows=500, size=2 << 20):
            ids, raw = columns_of(piece, "doc_id", "text")
            vectors = profiles.bundle([(t or b"").decode("utf-8", "replace") for t in raw])
            cosines = vectors @ matrix.T
            known = vectors.any(1) & bool(names)
            best, score = cosines.argmax(1), np.clip(cosines.max(1), 0, 1).astype(float)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array([names[b] if k else "und" for b, k in zip(best.tolist(), known.tolist())]),
                pa.array(np.where(known, score, 0.0))], names=["doc_id", "lang_pred", "score"])
    return texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


@query("op5_language_id")
def op5_language_id(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    prototypes = learn_languages(docs.where(third != 1))
    held = F.coalesce(third == 1, F.lit(False)).alias("held_out")
    return identify(docs, prototypes).select("doc_id", held, "lang_pred", "score")
