"""Token counts by compiled finite-state transducers.

A byte-level BPE tokenizer is compiled into a cascade of two deterministic transducers.

1. *Pre-tokens.* A machine of twelve states over character classes; each transition says where pre-tokens begin (at the
   character just read, or one before it). A batch of texts is cut into chunks of equal length. Every chunk is read from
   all twelve states at once, which gives its state map; the maps compose by a parallel prefix scan (doubling), so the
   state that enters each chunk is known without reading the chunks one after another. A second read marks the starts.
2. *Tokens.* A machine over the bytes of a pre-token. A state is what the rest can depend on: the longest suffix read
   that some vocabulary token begins with, and for its usable positions the last token and the token count relative to
   the end. A transition is annotated with the change in the number of tokens (negative when a byte lets tokens merge).
   The last token after a byte is the suffix token that stays apart from the last token before it, the known
   characterisation of BPE prefixes. States are compiled when text first reaches them, and shared by all words with the
   same ending, so their number levels off.

All pre-tokens of a batch step through the second machine together. Long ones are cut into chunks, which are lanes of their
own: a chunk maps the state it is entered in to the one it is left in, the maps compose along the pre-token, and a chunk is
read again only while the state that enters it still changes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabwright.llm.common import columns_of, pieces_of, table, texts
from tabwright.llm.registry import query

# Character classes. Some letters matter after an apostrophe only ('s 't 'm 'd 're 've 'll).
LETTER, SHORT, R, V, L, E, NUMBER, SPACE, BLANK, QUOTE, OTHER, END = range(12)
LETTERS = (LETTER, SHORT, R, V, L, E)
# States of the pre-token machine.
START, WORD, DIGITS, SIGNS, Q, QR, QV, QL, SP, WS, RUN_SP, RUN_WS = range(12)
HERE, BEFORE = 1, 2  # a pre-token starts at this character, at the one before


def _pretoken_machine() -> tuple[np.ndarray, np.ndarray]:
    """Flat tables over class * 12 + state: next state, and flags of the starts."""
    fresh = {**dict.fromkeys(LETTERS, WORD), NUMBER: DIGITS, SPACE: SP, BLANK: WS, QUOTE: Q, OTHER: SIGNS, END: START}

    def step(state: int, c: int) -> tuple[int, int]:
        begin = fresh[c], HERE
        letter, white = c in LETTERS, c in (SPACE, BLANK)
        run = RUN_SP if c == SPACE else RUN_WS
        if state == WORD and letter or state == DIGITS and c == NUMBER or state == SIGNS and c in (OTHER, QUOTE):
            return state, 0
        if state == Q:
            pending = {SHORT: START, R: QR, V: QV, L: QL, OTHER: SIGNS, QUOTE: SIGNS}
            return (pending[c], 0) if c in pending else begin
        if state in (QR, QV, QL):
            if c == (L if state == QL else E):
                return START, 0
            return (WORD, BEFORE) if letter else (begin[0], HERE | BEFORE)
        if state in (SP, WS, RUN_SP, RUN_WS) and white:
            return run, 0
        if c != END and state in (SP, RUN_SP):  # the last space joins what follows
            return (SIGNS if c == QUOTE else fresh[c]), BEFORE * (state == RUN_SP)
        if c != END and state == RUN_WS:
            return begin[0], HERE | BEFORE
        return begin

    pairs = [step(s, c) for c in range(12) for s in range(12)]
    return np.array([p[0] for p in pairs], np.uint8), np.array([p[1] for p in pairs], np.uint8)


NEXT, FLAGS = _pretoken_machine()


@lru_cache(maxsize=4)
def character_classes(path: str) -> bytes:
    """Class of every code point, read off the tokenizer's own pre-tokenizer; one byte each, 1.1 MB."""
    from tokenizers import Tokenizer
    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    classes = np.full(0x110000, OTHER, np.uint8)
    points = np.array([c for r in (range(0xD800), range(0xE000, 0x40000), range(0xE0000, 0xE1000)) for c in r])
    for part in np.array_split(points, 16):
        def joins(first: str) -> np.ndarray:
            text = "".join(f"\n{first}{chr(c)}" for c in part)
            starts = np.zeros(len(text) + 1, bool)
            starts[[a for _, (a, _) in split(text)]] = True
            return ~starts[2:len(text):3]
        other = joins("!")
        classes[part] = np.where(joins("a"), LETTER, np.where(joins("0"), NUMBER, np.where(other, OTHER, BLANK)))
    for chars, c in (("stmd", SHORT), ("r", R), ("v", V), ("l", L), ("e", E), (" ", SPACE), ("'", QUOTE)):
        classes[[ord(x) for x in chars]] = c
    return classes.tobytes()


def pretoken_starts(classes: np.ndarray, chunk: int = 256) -> np.ndarray:
    """Whether a pre-token starts at each character; END characters separate texts."""
    n = len(classes)
    lanes = max(1, -(-n // chunk))
    grid = np.full(lanes * chunk, END, np.uint8)
    grid[:n] = classes
    offsets = np.ascontiguousarray(grid.reshape(lanes, chunk).T) * np.uint8(12)
    maps = np.repeat(np.arange(12, dtype=np.uint8)[:, None], lanes, 1)  # [entry state, chunk]
    for row in offsets:
        maps = NEXT[row + maps]
    shift = 1
    while shift < lanes:  # inclusive scan: after it, a map leads from before the first chunk to after its own
        maps[:, shift:] = np.take_along_axis(maps[:, shift:], maps[:, :-shift], 0)
        shift *= 2
    state = np.concatenate([[START], maps[START, :-1]]).astype(np.uint8)
    flags = np.empty((chunk, lanes), np.uint8)
    for j, row in enumerate(offsets):
        at = row + state
        flags[j] = FLAGS[at]
        state = NEXT[at]
    flags = flags.T.reshape(-1)
    starts = flags & HERE > 0
    starts[:-1] |= flags[1:] & BEFORE > 0
    return starts[:n]


class Transitions:
    """Open-addressing table from state * 256 + byte to (state reached, change in tokens), looked up for many keys at once."""

    def __init__(self, bits: int = 21):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros(1 << bits, np.int64)
        self.used = 0

    def full(self) -> bool:
        return 2 * self.used > self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """state * 256 + change + 128 of each key, or -1."""
        slots = self._slots(keys)
        held = self.keys[slots]
        values = self.values[slots]
        other = np.flatnonzero(held != keys)
        while len(other):
            empty = held[other] < 0
            values[other[empty]] = -1
            other = other[~empty]
            slots[other] = (slots[other] + 1) & self.mask
            held[other] = self.keys[slots[other]]
            values[other] = self.values[slots[other]]
            other = other[held[other] != keys[other]]
        return values

    def widen(self) -> None:
        held = self.keys >= 0
        keys, values = self.keys[held].tolist(), self.values[held].tolist()
        self.__init__(self.mask.bit_length() + 1)
        self.add(keys, values)

    def add(self, keys: list[int], values: list[int]) -> None:
        """New keys; they are distinct."""
        for key, slot, value in zip(keys, self._slots(np.array(keys, np.int64)).tolist(), values):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.values[slot] = key, value
        self.used += len(keys)


class TokenMachine:
    """The second transducer of one tokenizer, compiled on demand; forgotten between batches beyond ``most`` states."""

    def __init__(self, path: str, most: int = 250_000, chunk: int = 512):
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        self.model, self.most, self.chunk = tokenizer.model, most, chunk
        self.specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        names = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.names = [names[b] for b in range(256)]
        self.vocabulary = {t: i for t, i in tokenizer.get_vocab(with_added_tokens=False).items()}
        self.text_of = {i: t for t, i in self.vocabulary.items()}
        self.begins = {t[:k] for t in self.vocabulary for k in range(1, len(t) + 1)}
        self.clear()

    def clear(self) -> None:
        start = ("", ((0, -1, 0),))  # (suffix, ((position, last token, count relative to the end), ...))
        self.ids, self.states = {start: 0}, [start]
        self.steps = Transitions()
        self.apart: dict[int, bool] = {}

    def _stay_apart(self, left: int, right: int) -> bool:
        if left < 0:
            return True
        known = self.apart.get(left << 32 | right)
        if known is None:
            found = self.model.tokenize(self.text_of[left] + self.text_of[right])
            known = self.apart[left << 32 | right] = [t.id for t in found] == [left, right]
        return known

    def _compile(self, state: int, byte: int) -> int:
        suffix, known = self.states[state]
        text = suffix + self.names[byte]
        for position, last, count in known:  # from the longest suffix on
            token = self.vocabulary.get(text[position:])
            if token is not None and self._stay_apart(last, token):
                break
        else:
            raise ValueError("the vocabulary does not hold every byte")
        change = count + 1
        cut = next(k for k in range(len(text)) if text[k:] in self.begins)
        kept = [(p - cut, t, c - change) for p, t, c in known if p >= cut and text[p:] in self.begins]
        reached = (text[cut:], (*kept, (len(text) - cut, token, 0)))
        if reached not in self.ids:
            self.ids[reached] = len(self.states)
            self.states.append(reached)
        return self.ids[reached] * 256 + change + 128

    def _read(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens added by, and state after, each data[start:start + length] entered in the state ``entry``."""
        order = np.argsort(-lengths, kind="stable")
        at, sizes = starts[order], lengths[order]
        state, tokens = entry[order].astype(np.int64), np.zeros(len(order), np.int64)
        active, j = int((sizes > 0).sum()), 0
        while active:
            keys = state[:active] * 256 + data[at[:active] + j]
            reached = self.steps.find(keys)
            if (missing := reached < 0).any():
                pairs = np.unique(keys[missing]).tolist()
                self.steps.add(pairs, [self._compile(*divmod(pair, 256)) for pair in pairs])
                if self.steps.full():
                    self.steps.widen()
                reached = self.steps.find(keys)
            tokens[:active] += (reached & 255) - 128
            state[:active] = reached >> 8
            j += 1
            active = int(np.searchsorted(-sizes[:active], -j, "left"))
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return tokens[back], state[back]

    def counts(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token data[start:start + length]."""
        if len(self.states) > self.most:
            self.clear()
        pieces = np.maximum(1, -(-lengths // self.chunk))
        owner = np.repeat(np.arange(len(lengths)), pieces)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = starts[owner] + within * self.chunk
        size = np.minimum(self.chunk, lengths[owner] - within * self.chunk)
        entry = np.zeros(len(owner), np.int64)
        tokens, left = self._read(data, at, size, entry)
        while True:  # each turn settles at least the next chunk of every pre-token
            enters = np.where(within > 0, np.concatenate([[0], left[:-1]]), 0)
            again = np.flatnonzero(enters != entry)
            if not len(again):
                break
            entry = enters
            tokens[again], left[again] = self._read(data, at[again], size[again], entry[again])
        return np.bincount(owner, tokens, len(lengths)).astype(np.int64)


@lru_cache(maxsize=2)
def token_machine(path: str) -> TokenMachine:
    return TokenMachine(path)


def batch_counts(texts_: list[str], machine: TokenMachine, classes: np.ndarray) -> np.ndarray:
    """Tokens of each text; special strings inside a text are one token each and end the text before them."""
    parts, owner, extra = [], [], np.zeros(len(texts_), np.int64)
    for i, text in enumerate(texts_):
        pieces = [text]
        for special in machine.specials:
            pieces = [x for p in pieces for x in p.split(special)] if special in text else pieces
        extra[i] = len(pieces) - 1
        parts += pieces
        owner += [i] * len(pieces)
    sizes = np.array([len(p) for p in parts], np.int64)
    points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
    ends = np.cumsum(sizes + 1) - 1
    kinds = np.full(len(points) + len(parts), END, np.uint8)
    real = np.ones(len(kinds), bool)
    real[ends] = False
    kinds[real] = classes[points]
    starts = pretoken_starts(kinds) & real
    width = np.zeros(len(kinds), np.int64)
    width[real] = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    byte_at = np.cumsum(width) - width
    data = np.frombuffer("".join(parts).encode(), np.uint8)
    begin = np.flatnonzero(starts)
    from_byte = byte_at[begin]
    tokens = machine.counts(data, from_byte, np.diff(np.append(from_byte, len(data))))
    text_of = np.array(owner, np.int64)[np.searchsorted(ends, begin)]
    return extra + np.bincount(text_of, tokens, len(texts_)).astype(np.int64)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text).

    ``tokenizer`` is the path of a byte-level BPE file on every worker and the driver. A null text counts as empty;
    null and repeated doc_ids are rows like any other; other columns are ignored.
    """
    classes = character_classes(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, table_ = token_machine(tokenizer), np.frombuffer(classes, np.uint8)
        for piece in pieces_of(batches, rows=4_000, size=4 << 20):
            ids, raw = columns_of(piece, "doc_id", "text")
            raw = [t or b"" for t in raw]
            n = batch_counts([t.decode("utf-8", "replace") for t in raw], machine, table_)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(t) for t in raw], pa.int64()), pa.array(n)],
                names=["doc_id", "n_bytes", "n_tokens"])
    counted = texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


@query("op9_token_counts")
def op9_token_counts(spark, folder):
    import public_tokenizers
    return count_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
