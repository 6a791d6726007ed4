"""Packing of token sequences by minimum bin slack.

Token ids of a document are the ids of its text, then an end id. Documents longer than a window give full windows and
a remainder. Each window is then filled from the multiset of remaining lengths: the longest one is taken, and a bitset
subset-sum (bit s set: some choice of the other lengths sums to s) finds the choice that comes closest to the capacity;
walking the bitsets back gives how often each length is used. A choice is repeated as long as the multiset allows.

Windows are filled within a task from groups of a bounded number of tokens, so nothing is shuffled and no group grows
with the input. When no choice fills a window exactly, a document is cut to fill it; what is left at the end of a task
is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter, defaultdict, deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tabwright.llm.common import columns_of, pieces_of, table, texts
from tabwright.llm.registry import query

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "sequence_length long")


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How often to take each length, at most ``counts`` times, for the largest sum within ``room``.

    Bit s of ``reach`` says that the lengths so far can sum to s. The lengths join from the longest on, a multiple of
    a length by doubling (1, 2, 4, ... copies), and the search ends as soon as ``room`` itself can be reached.
    """
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        left, copies = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            take = min(copies, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & full
            left -= take
            copies *= 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


def fill_windows(lengths: Iterable[int], capacity: int) -> tuple[list[tuple[dict[int, int], int]], Counter]:
    """(multiset, repeats) of the windows filled exactly, and the multiset that no window took."""
    counts = Counter(n for n in lengths if n)
    windows, failed = [], Counter()
    while counts:
        longest = max(counts)
        rest = dict(counts)
        rest[longest] -= 1
        chosen = best_fill({n: c for n, c in rest.items() if c}, capacity - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        if sum(n * c for n, c in chosen.items()) < capacity:
            failed[longest] += counts.pop(longest)  # the same length would fail again
            continue
        times = min(counts[n] // c for n, c in chosen.items())
        windows.append((chosen, times))
        for n, c in chosen.items():
            counts[n] -= c * times
            if not counts[n]:
                del counts[n]
    return windows, failed


class Packer:
    """Packs the documents of one task; ``group`` tokens are packed at a time, what they leave goes to the next group."""

    def __init__(self, capacity: int, group: int, first_id: int):
        self.capacity, self.group, self.next_id = capacity, group, first_id
        self.waiting: list[tuple] = []  # (doc_id, ids, start, doc_tokens) of remainders
        self.held, self.rows = 0, []

    def put(self, doc_id, ids: np.ndarray) -> None:
        n, capacity = len(ids), self.capacity
        whole = n - n % capacity
        for start in range(0, whole, capacity):
            self._sequence([(doc_id, ids[start:start + capacity], start, n)])
        if whole < n:
            self.waiting.append((doc_id, ids[whole:].copy(), whole, n))
            self.held += n - whole
        if self.held >= self.group:
            self.flush(False)

    def _sequence(self, parts: list[tuple]) -> None:
        offset, total = 0, sum(len(p[1]) for p in parts)
        for doc_id, ids, start, n in parts:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), n, self.next_id, offset, total))
            offset += len(ids)
        self.next_id += 1

    def flush(self, last: bool) -> None:
        by_length = defaultdict(deque)
        for part in self.waiting:
            by_length[len(part[1])].append(part)
        windows, failed = fill_windows((len(p[1]) for p in self.waiting), self.capacity)
        for chosen, times in windows:
            for _ in range(times):
                self._sequence([by_length[n].popleft() for n, c in chosen.items() for _ in range(c)])
        rest = [p for n in sorted(failed, reverse=True) for p in by_length[n]]
        queue, self.waiting, self.held = deque(rest), [], 0
        left = sum(len(p[1]) for p in queue)
        while left >= self.capacity:
            self._sequence(self._cut(queue, self.capacity))
            left -= self.capacity
        if not last:
            self.waiting, self.held = list(queue), left
            return
        while left:
            size = 1 << (left.bit_length() - 1)
            self._sequence(self._cut(queue, size))
            left -= size

    @staticmethod
    def _cut(queue: deque, size: int) -> list[tuple]:
        parts = []
        while size:
            doc_id, ids, start, n = queue.popleft()
            if len(ids) > size:
                queue.appendleft((doc_id, ids[size:], start + size, n))
                ids = ids[:size]
            parts.append((doc_id, ids, start, n))
            size -= len(ids)
        return parts


# The tokenizer's pre-tokens, spelled out for the characters below U+0100, with its white space.
LATIN_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|"
                          "[^\t-\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")


class WordIds:
    """Ids of a text by a tokenizer that lower-cases, drops white space and encodes each pre-token by itself.

    For texts below U+0100, where normalisation is no more than lower-casing, each distinct pre-token is encoded once
    by the tokenizer's model; the cache is emptied when it has ``most`` of them. All other texts, and those that hold
    a special string, go through the whole tokenizer.
    """

    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.cache, self.most = self.tokenizer.model, {}, most
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        names = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.named = {c: "".join(names[b] for b in chr(c).encode()) for c in range(256)}

    def _learn(self, pieces: set[str]) -> None:
        """The model's ids of each pre-token, which it wants written in the names of its bytes."""
        tokenize = self.model.tokenize
        for piece in pieces:
            tokens = tokenize(piece if piece.isascii() and piece.isprintable() else piece.translate(self.named))
            self.cache[piece] = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        cache, found, fresh = self.cache, [], set()
        if len(cache) > self.most:
            cache.clear()
        for text in batch:
            try:
                text.encode("latin-1")
                pieces = None if any(s in text for s in self.specials) else LATIN_PIECES.findall(text.lower())
            except UnicodeEncodeError:
                pieces = None
            found.append(pieces)
            fresh.update(pieces or ())
        self._learn(fresh.difference(cache))
        return [np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4") if pieces is None
                else np.frombuffer(b"".join(map(cache.__getitem__, pieces)), "<u4")
                for text, pieces in zip(batch, found)]


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, group: int = 2_000_000) -> DataFrame:
    """One row per piece of a document (column ``text``, key ``doc_id``): its ids' place in the document and in a sequence.

    ``tokenizer`` is the path of a tokenizer file on every worker. ``group`` bounds the tokens a task packs together.
    A null text is an empty one: its document is the end id alone. Null and repeated doc_ids are packed like any other
    row; other columns are ignored. An empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer)
        packer = Packer(capacity, group, TaskContext.get().partitionId() << 36)
        end = np.array([end_id], "<u4")

        def rows():
            out, packer.rows = packer.rows, []
            columns = list(zip(*out)) or [()] * len(NAMES)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=NAMES)
        for piece in pieces_of(batches, size=8 << 20):
            ids, raw = columns_of(piece, "doc_id", "text")
            for doc_id, found in zip(ids, words.encode([(t or b"").decode("utf-8", "replace") for t in raw])):
                packer.put(doc_id, np.concatenate([found, end]))
            if packer.rows:
                yield rows()
        packer.flush(True)
        if packer.rows:
            yield rows()
    return texts(docs).mapInArrow(run, SCHEMA)


NAMES = [part.split()[0] for part in SCHEMA.split(", ")]


@query("op10_packing")
def op10_packing(spark, folder):
    import public_tokenizers
    return pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)
