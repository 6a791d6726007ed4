"""Quality classifier by co-training on two views of a document.

The features of every document are made once and written as a table; rounds and scoring read numbers only.

The content view sees the words of the whole text and its shape; the metadata view sees what the crawl knows about it
(source, language, length class) and never the text. Both start from labelled documents. In each round both classifiers
score all unlabelled documents where these are, and hand confident decisions of each class to the other as labels; only the
documents handed over are bounded, per class, by id hash. In the end each view
is calibrated on labelled documents that neither was trained on, and the calibrated log-odds are combined there too.

Two faults are learned this way, low quality and toxicity; a document is rejected when the combined probability of either
reaches the threshold.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from tabwright.llm.common import columns_of, dropped, first_by_hash, pieces_of, table, written
from tabwright.llm.registry import query

BUCKETS = 1 << 18
SHAPES = 12
WORD = re.compile(r"[^\W\d_]+|[^\w\s]{2,}")
META_BUCKETS = 1 << 12


def _bin(x: float, edges: tuple) -> int:
    return int(np.searchsorted(edges, x, "right"))


def content_features(text: str | None, cache: dict[str, list[int]], used: bytes | None = None) -> np.ndarray:
    """Hashed presence of words, their beginnings and sign runs, and of shape classes; sorted numbers below BUCKETS.

    ``used`` has a byte for each number, 0 where no model has a weight: those are left out.
    """
    text = text or ""
    words = WORD.findall(text.lower())
    found = set()
    for w in set(words):
        known = cache.get(w)
        if known is None:  # the word and its beginnings
            known = [zlib.crc32(x.encode("utf-8", "replace")) % (BUCKETS - 256) + 256
                     for x in (w, *[f"{w[:k]}-" for k in (4, 5, 6) if len(w) > k])]
            cache[w] = known = known if used is None else tuple(h for h in known if used[h])
        if known:
            found.update(known)
    n, lines = max(1, len(text)), text.split("\n")
    signs = sum(map(text.count, "|#$%&*<>{}[]=\\~^@_"))
    shares = (signs / n, text.count(".") / n, len(set(words)) / max(1, len(words)), len(words) / n,
              len(set(lines)) / len(lines), sum(map(text.count, "0123456789")) / n, sum(map(text.count, "!?")) / n)
    edges = ((.001, .01, .03, .08), (.002, .005, .01, .02), (.2, .4, .6, .8), (.1, .13, .16, .2), (.3, .6, .9, .999),
             (.01, .05, .2), (.001, .01, .05))
    found.update(SHAPES * i + _bin(x, e) for i, (x, e) in enumerate(zip(shares, edges)))
    return np.array(sorted(found), np.int32)


def metadata_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    length = 0 if n_chars is None else int(max(0, n_chars)).bit_length() + 1
    marks = (f"s:{source}", f"l:{lang}", f"n:{length}", f"s:{source} l:{lang}", f"l:{lang} n:{length}")
    return np.unique([zlib.crc32(m.encode("utf-8", "replace")) % META_BUCKETS for m in marks]).astype(np.int32)


STEP = 65_535  # a gap in packed features that says: go on by as much


def packed(features: np.ndarray) -> bytes:
    """Sorted numbers as 16-bit gaps; wider gaps take several steps."""
    gaps = np.diff(features, prepend=np.int32(0)).astype(np.int64)
    wide = gaps // STEP
    if wide.any():
        gaps = np.concatenate([[*[STEP] * w, g] for w, g in zip(wide.tolist(), (gaps % STEP).tolist())])
    return gaps.astype(np.uint16).tobytes()


@dataclass
class Sets:
    """Feature sets of a batch of documents: all numbers one after another, and how many each document has."""

    flat: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> Sets:
        return cls(np.concatenate(rows) if rows else np.zeros(0, np.int32), np.array([len(r) for r in rows], np.int64))

    @classmethod
    def unpacked(cls, raw: list[bytes]) -> Sets:
        sizes = np.array([len(r) // 2 for r in raw], np.int64)
        gaps = np.frombuffer(b"".join(raw), np.uint16)
        run = np.concatenate([[0], np.cumsum(gaps, dtype=np.int64)])
        ends = np.cumsum(sizes)
        flat = (run[1:] - np.repeat(run[ends - sizes], sizes)).astype(np.int32)
        real = gaps != STEP
        if not real.all():
            seen = np.concatenate([[0], np.cumsum(real)])
            flat, sizes = flat[real], seen[ends] - seen[ends - sizes]
        return cls(flat, sizes)

    def rows(self) -> list[np.ndarray]:
        return np.split(self.flat, np.cumsum(self.sizes)[:-1]) if len(self.sizes) else []


@dataclass
class Linear:
    """Logistic model on sets of features."""

    weights: np.ndarray
    bias: float = 0.0

    def margin(self, rows: list[np.ndarray] | Sets) -> np.ndarray:
        sets = rows if isinstance(rows, Sets) else Sets.of(rows)
        if not len(sets.flat):
            return np.full(len(sets.sizes), self.bias)
        sums = np.concatenate([[0.0], np.cumsum(self.weights[sets.flat])])
        ends = np.cumsum(sets.sizes)
        return self.bias + sums[ends] - sums[ends - sets.sizes]


def train(rows: list[np.ndarray], y: np.ndarray, size: int, epochs: int = 120, penalty: float = 1e-3,
          least: float = 4.0) -> Linear:
    """Logistic regression by Adagrad over the whole sample, on the features that tell the classes apart.

    A feature is used if its shares in the two classes differ by ``least`` standard errors; there are many more features
    than documents, and the others would only be learnt by heart. Classes weigh the same.
    """
    positive = y > 0.5
    n1, n0 = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    k1, k0 = np.zeros(size), np.zeros(size)
    for r, p in zip(rows, positive.tolist()):
        (k1 if p else k0)[r] += 1  # a set has a feature once
    share = (k1 + k0) / (n1 + n0)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
    telling = np.abs(k1 / n1 - k0 / n0) >= least * error
    columns = np.flatnonzero(telling & (k1 + k0 > 0))
    place = np.zeros(size, np.int32)
    place[columns] = np.arange(len(columns))
    kept = [place[r[telling[r]]] for r in rows]  # only what can get a weight is held twice
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in kept])
    where = np.concatenate(kept) if kept else np.zeros(0, np.int32)
    del kept
    weight = np.where(positive, 0.5 / n1, 0.5 / n0)
    w, b, seen, seen_b = np.zeros(len(columns)), 0.0, np.full(len(columns), 1e-10), 1e-10
    for _ in range(epochs):
        z = b + np.bincount(owner, w[where], len(rows))
        slope = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.bincount(where, slope[owner], len(columns)) + penalty * w / max(1, len(columns))
        seen += g * g
        w -= 0.3 * g / np.sqrt(seen)
        seen_b += slope.sum() ** 2
        b -= 0.3 * slope.sum() / np.sqrt(seen_b)
    out = np.zeros(size)
    out[columns] = w
    return Linear(out, b)


def fit_odds(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights and bias of a lightly penalised logistic regression on few columns, by Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T * (p * (1 - p)) @ a + 0.1 * np.eye(len(w)), a.T @ (p - y) + 0.1 * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


@dataclass
class Fault:
    """The two views of one fault, their calibrations and their combination."""

    content: Linear
    metadata: Linear
    calibrations: tuple[np.ndarray, np.ndarray]
    combination: np.ndarray

    def probability(self, content: list[np.ndarray] | Sets, metadata: list[np.ndarray] | Sets) -> np.ndarray:
        z = np.column_stack([self._odds(0, content), self._odds(1, metadata)])
        return 1 / (1 + np.exp(-np.clip(z @ self.combination[:2] + self.combination[2], -30, 30)))

    def _odds(self, view: int, rows: list[np.ndarray] | Sets) -> np.ndarray:
        scale, shift = self.calibrations[view]
        return scale * (self.content, self.metadata)[view].margin(rows) + shift


@dataclass
class Learner:
    """One fault while its views teach each other. Rows at places divisible by four are kept for calibration."""

    views: tuple[list, list]
    y: np.ndarray
    models: list[Linear]
    confident: float

    @classmethod
    def start(cls, views: tuple[list, list], y: np.ndarray, confident: float = 0.95) -> Learner:
        learner = cls(views, y, [], confident)
        learner.teach([[], []], np.zeros(0), np.zeros(0))
        return learner

    def _held(self) -> np.ndarray:
        return np.arange(len(self.y)) % 4 == 0

    def teach(self, given: list[list], *labels: np.ndarray) -> None:
        """Trains each view on its labelled rows and on ``given[v]``: rows of view v with ``labels[v]``, by the other view."""
        own = np.flatnonzero(~self._held())
        self.models = [train([self.views[v][i] for i in own] + given[v], np.concatenate([self.y[own], labels[v]]), size)
                       for v, size in enumerate((BUCKETS, META_BUCKETS))]

    def calibrations(self) -> tuple[np.ndarray, np.ndarray]:
        held = np.flatnonzero(self._held())
        return tuple(fit_odds(self.models[v].margin([self.views[v][i] for i in held])[:, None], self.y[held]) for v in (0, 1))

    def finish(self) -> Fault:
        held = np.flatnonzero(self._held())
        fault = Fault(*self.models, self.calibrations(), np.array([1.0, 1.0, 0.0]))
        odds = [fault._odds(v, [self.views[v][i] for i in held]) for v in (0, 1)]
        fault.combination = fit_odds(np.column_stack(odds), self.y[held])
        return fault


@dataclass
class Teacher:
    """What scoring needs of a learner: each view's model and calibration."""

    models: list[Linear]
    scales: tuple[np.ndarray, np.ndarray]
    confident: float

    def decisions(self, views: tuple) -> list[np.ndarray]:
        """Of each view: 1 or 0 where it is sure of that class, -1 elsewhere."""
        out = []
        for model, (scale, shift), rows in zip(self.models, self.scales, views):
            p = 1 / (1 + np.exp(-np.clip(scale * model.margin(rows) + shift, -30, 30)))
            out.append(np.where(p >= self.confident, 1, np.where(1 - p >= self.confident, 0, -1)))
        return out


def used_features(models: Iterable[Linear]) -> bytes:
    """A byte for each content feature: whether any of the content models has a weight for it."""
    used = np.zeros(BUCKETS, bool)
    for model in models:
        used |= model.weights != 0
    return used.tobytes()


FEATURES = "doc_id long, content binary, metadata binary"


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, content, metadata): both views of every row, packed; the texts are read whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list[int]] = {}
        for piece in pieces_of(batches):
            if len(cache) > 200_000:
                cache.clear()
            ids, text, source, lang, n = columns_of(piece, "doc_id", "text", "source", "lang", "n_chars")
            arrays = [[packed(content_features(t, cache)) for t in text],
                      [packed(metadata_features(*x)) for x in zip(source, lang, n)]]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(x, pa.binary()) for x in arrays]],
                                             names=["doc_id", "content", "metadata"])
    return _inputs(docs).mapInArrow(run, FEATURES)


def _views(piece: pa.RecordBatch) -> tuple[Sets, Sets]:
    return tuple(map(Sets.unpacked, columns_of(piece, "content", "metadata")))


def _inputs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"),
                       F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"))


def sure_decisions(features: DataFrame, teachers: Broadcast) -> DataFrame:
    """(doc_id, fault, view, label) of every decision that a view is sure of."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces_of(batches):
            ids, views = piece.column(0), _views(piece)
            for fault, teacher in teachers.value.items():
                for view, sure in enumerate(teacher.decisions(views)):
                    at = np.flatnonzero(sure >= 0)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(at)), pa.array([fault] * len(at), pa.string()),
                         pa.array([view] * len(at), pa.int64()), pa.array(sure[at], pa.int64())],
                        names=["doc_id", "fault", "view", "label"])
    return features.mapInArrow(run, "doc_id long, fault string, view long, label long")


def _one_row_each(features: DataFrame, ids: DataFrame) -> list:
    """Both views of one row per chosen id, in the order of the id hash; an id on many rows counts once."""
    found = features.join(F.broadcast(ids), "doc_id")
    first = found.groupBy("doc_id").agg(F.min_by(F.struct(*[c for c in found.columns if c != "doc_id"]),
                                                 F.xxhash64("content", "metadata")).alias("r")).select("doc_id", "r.*")
    return first.orderBy(F.xxhash64("doc_id")).collect()


def _unpacked(rows: list) -> tuple[list, list]:
    return tuple(Sets.unpacked([r[v] for r in rows]).rows() for v in ("content", "metadata"))


def learn_quality(features: DataFrame, labels: DataFrame, labelled: int = 2_500, most: int = 300, rounds: int = 3) -> dict[str, Fault]:
    """Classifiers of the faults from at most ``labelled`` documents of each (quality, toxic) pair and all unlabelled ones.

    ``features`` is a table written from ``featured``. The labelled documents are chosen by smallest id hash, on ids alone.
    Labels without id, or null in both columns, are left out; of several labels of a document the worst counts. In each
    round both views score every unlabelled document, and at most ``most`` confident ones per fault, view and class, by id
    hash, become training rows of the other view. A fault that the sample has on none or all of its documents is not learned.
    """
    spark = features.sparkSession
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(1 - F.min("quality"), F.lit(0)).cast("long").alias("low"),
        F.coalesce(F.max("toxic"), F.lit(0)).cast("long").alias("toxic"))
    rows = _one_row_each(features, first_by_hash(known, ["low", "toxic"], "doc_id", labelled).drop("_place"))
    views, ys = _unpacked(rows), {name: np.array([r[name] for r in rows], float) for name in ("low", "toxic")}
    del rows
    learners: dict[str, Learner] = {}
    for name, y in ys.items():
        if len(set(y.tolist())) == 2 and len(set(y[::4].tolist())) == 2 and len(set(np.delete(y, np.s_[::4]).tolist())) == 2:
            learners[name] = Learner.start(views, y)
    identified = features.where("doc_id is not null")
    for _ in range(rounds if learners else 0):
        shared = spark.sparkContext.broadcast(
            {name: Teacher(x.models, x.calibrations(), x.confident) for name, x in learners.items()})
        # decisions are few bytes: they, not the features, are joined with the labels
        sure = written(sure_decisions(identified, shared).join(known.select("doc_id"), "doc_id", "left_anti").groupBy(
            "doc_id", "fault", "view").agg(F.min("label").alias("label"), F.max("label").alias("_other")).where(
            "label = _other").drop("_other"), "quality-sure")
        shared.destroy()
        given = first_by_hash(sure, ["fault", "view", "label"], "doc_id", most).drop("_place").collect()
        dropped(sure)
        if not given:
            break
        ids = spark.createDataFrame([(i,) for i in sorted({g.doc_id for g in given})], "doc_id long")
        found = _one_row_each(features, ids)
        seen = {r.doc_id: x for r, x in zip(found, zip(*_unpacked(found)))}
        for name, learner in learners.items():
            # what one view decided is training for the other
            to = [sorted((g.doc_id, g.label) for g in given if g.fault == name and g.view == 1 - v) for v in (0, 1)]
            learner.teach([[seen[i][v] for i, _ in to[v]] for v in (0, 1)], *[np.array([x for _, x in t], float) for t in to])
    return {name: learner.finish() for name, learner in learners.items()}


def score_quality(features: DataFrame, faults: dict[str, Fault]) -> DataFrame:
    """doc_id, p_low, p_toxic and quality (one minus the larger) for every row of ``features``; 0 for a fault not learned.

    Null texts and metadata are scored as such; null and repeated doc_ids are rows like any other.
    """
    shared = features.sparkSession.sparkContext.broadcast(faults)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces_of(batches):
            views, n = _views(piece), piece.num_rows
            p = [shared.value[f].probability(*views) if f in shared.value else np.zeros(n) for f in ("low", "toxic")]
            yield pa.RecordBatch.from_arrays([piece.column(0), *map(pa.array, p), pa.array(1 - np.maximum(*p))],
                                             names=["doc_id", "p_low", "p_toxic", "quality"])
    return features.mapInArrow(run, "doc_id long, p_low double, p_toxic double, quality double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.75) -> DataFrame:
    """The scores and ``keep``: the quality is above ``1 - threshold``."""
    features = written(featured(docs), "quality-features")
    return score_quality(features, learn_quality(features, labels)).withColumn("keep", F.col("quality") > 1 - threshold)


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.75) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns; one pass, no join."""
    features = written(featured(docs), "quality-features")
    shared = docs.sparkSession.sparkContext.broadcast(learn_quality(features, labels))
    dropped(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list[int]] = {}
        used = used_features(f.content for f in shared.value.values())
        for piece in pieces_of(batches):
            if len(cache) > 500_000:
                cache.clear()
            text, source, lang, n = columns_of(piece, "text", "source", "lang", "n_chars")
            views = [content_features(t, cache, used) for t in text], [metadata_features(*x) for x in zip(source, lang, n)]
            worst = np.max([f.probability(*views) for f in shared.value.values()] or [np.zeros(len(text))], axis=0)
            yield piece.filter(pa.array(worst < threshold))
    return docs.mapInArrow(run, docs.schema)


@query("op7_quality")
def op7_quality(spark, folder):
    return classify(table(spark, folder, "documents"), table(spark, folder, "labels"))
