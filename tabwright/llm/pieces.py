"""Offset-preserving piece encoding and decoding.

A model file is compiled into three parts:

1. *Normalisation.* The compiled character map (a double array of byte transitions, followed by replacement strings) is
   unfolded into its rules; at each position of a text the longest rule applies, other characters stay. White space is
   escaped, a leading mark added, extra white space removed, as the model says. Every normalised character keeps the
   byte of the source where the text it came from begins.
2. *Merges.* The best-scored adjacent pair merges first, the left one among equals. No merge crosses a pair of
   characters that occurs in no piece, so a text falls into stretches, mostly words, whose encodings are kept in a
   bounded table.
3. *Projection.* A piece covers a stretch of normalised characters; the alignment of (1) gives its span of source bytes.
   A character without a piece becomes its bytes: the last byte piece has the whole span, the others an empty one.

Decoding goes from the ids back through the pieces' surfaces and bytes.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabwright.llm.common import columns_of, pieces_of, table, texts
from tabwright.llm.registry import query

MARK = "▁"
# Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
# An encoded piece: its id and the number of normalised characters that it covers.
PIECE, PACKED = struct.Struct("<iH"), np.dtype([("id", "<i4"), ("covered", "<u2")])
NO_PIECE = float("inf")


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value
    while at < len(data):
        field, kind = divmod(number(), 8)
        if kind == 0:
            yield field, number()
            continue
        size = {1: 8, 5: 4}[kind] if kind != 2 else number()
        yield field, data[at:at + size]
        at += size


def unfolded(charsmap: bytes) -> dict[str, str]:
    """The rules (source, replacement) of a compiled character map."""
    if not charsmap:
        return {}
    size, = struct.unpack_from("<I", charsmap)
    units, strings = np.frombuffer(charsmap, np.uint32, size // 4, 4).astype(np.int64), charsmap[4 + size:]
    jump = (units >> 10) << ((units & 512) >> 6)
    label, ends = units & 0x800000FF, units >> 8 & 1
    letters, rules = np.arange(1, 256), {}
    nodes = [(int(jump[0]), b"")]
    while nodes:
        base, source = nodes.pop()
        child = base ^ letters
        child = child[child < len(units)]
        child = child[label[child] == (base ^ child)]
        for c in child.tolist():
            reached = source + bytes([base ^ c])
            below = c ^ int(jump[c])
            if ends[c]:
                start = int(units[below]) & 0x7FFFFFFF
                rules[reached.decode()] = strings[start:strings.index(b"\0", start)].decode()
            nodes.append((below, reached))
    return rules


class Normalizer:
    """Longest-prefix replacement with alignment; options as in the model file."""

    def __init__(self, rules: dict[str, str], prefix: bool = True, trim: bool = True, escape: bool = True):
        self.rules, self.prefix, self.trim, self.space = rules, prefix, trim, MARK if escape else " "
        self.plain = not rules and not trim
        self.lengths: dict[str, list[int]] = {}
        for source in rules:
            self.lengths.setdefault(source[0], []).append(len(source))
        for sizes in self.lengths.values():
            sizes[:] = sorted(set(sizes), reverse=True)
        heads = "".join(re.escape(c) for c in self.lengths)
        self.head = re.compile(f"[{heads}]") if heads else None

    def _units(self, text: str) -> Iterator[tuple[str, int, int]]:
        """(replacement, start, end in characters) one after another; stretches without any rule as they are."""
        at = 0
        while self.head and (found := self.head.search(text, at)):
            start = found.start()
            size = next((n for n in self.lengths[text[start]] if text[start:start + n] in self.rules), 0)
            if size:
                if start > at:
                    yield text[at:start], at, start
                yield self.rules[text[start:start + size]], start, start + size
                at = start + size
            else:
                yield text[at:start + 1], at, start + 1
                at = start + 1
        if at < len(text):
            yield text[at:], at, len(text)

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and the source byte of each of its characters and of its end."""
        if not text:
            return "", np.zeros(1, np.int32)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        byte_at = np.zeros(len(points) + 1, np.int32)
        np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), out=byte_at[1:])
        if self.plain:
            lead = np.zeros(1 if self.prefix else 0, np.int32)
            return self.space * len(lead) + text.replace(" ", self.space), np.concatenate([lead, byte_at])
        chars, origin, first = [], [], None
        for out, start, end in self._units(text):
            chars.append(out)
            same = end - start == len(out) and text[start:end] == out
            if first is None:  # where the text begins, after blanks that stand alone
                blanks = len(out) - len(out.lstrip(" ")) if same else int(out == " ")
                if blanks < len(out) or not out:
                    first = int(byte_at[start + blanks])
            origin.append(byte_at[start:end] if same else np.full(len(out), byte_at[start], np.int32))
        whole = "".join(chars)
        source = np.concatenate([*origin, byte_at[-1:]])
        if self.trim:
            blank = np.frombuffer(whole.encode("utf-32-le"), np.uint32) == 32
            if blank.all():
                return "", np.zeros(1, np.int32)
            keep = ~(blank & np.concatenate([[True], blank[:-1]]))
            source = np.concatenate([source[:-1][keep], source[-1:]])
            whole = "".join(c for c, k in zip(whole, keep.tolist()) if k)
        lead = np.full(1 if self.prefix else 0, first if self.trim else 0, np.int32)
        whole = self.space * len(lead) + whole.replace(" ", self.space)
        source = np.concatenate([lead, source])
        if self.trim:  # the text ends where its last blanks begin
            whole = whole.rstrip(self.space)
            source = source[:len(whole) + 1]
        return whole, source


class PieceModel(dict):
    """Stretch -> its pieces, packed; filled on demand, cleared beyond ``most``."""

    def __init__(self, data: bytes, most: int = 600_000, short: int = 48):
        super().__init__()
        self.most, self.short = most, short
        self.surface: list[str] = []
        self.kind: list[int] = []
        self.ids: dict[str, int] = {}
        self.cost: dict[str, float] = {}
        spec: dict[int, int | bytes] = {}
        for field, value in wire_fields(data):
            if field == 1:
                parts = dict(wire_fields(value))
                piece, kind = parts[1].decode(), parts.get(3, NORMAL)
                if kind not in (NORMAL, UNKNOWN, CONTROL, BYTE):
                    raise ValueError("pieces are normal, unknown, control or byte pieces here")
                if kind == NORMAL:
                    self.ids[piece] = len(self.kind)
                    self.cost[piece] = -struct.unpack("<f", parts.get(2, bytes(4)))[0]
                self.surface.append(piece)
                self.kind.append(kind)
            elif field == 2:
                training = dict(wire_fields(value))
                if training.get(3, 1) != 2 or not training.get(35, 0) or training.get(24, 0):
                    raise ValueError("only merge models with byte fallback and leading marks")
            elif field == 3:
                spec |= dict(wire_fields(value))
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.surface) if self.kind[i] == BYTE}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        # Pieces that read alike wherever they stand: normal ones, and bytes that are a character.
        self.text_of = [p.replace(MARK, " ") if k == NORMAL else chr(self.byte_of[i]) if self.byte_of.get(i, 128) < 128 else ""
                        for i, (p, k) in enumerate(zip(self.surface, self.kind))]
        self.simple = np.array([k == NORMAL or self.byte_of.get(i, 128) < 128 for i, k in enumerate(self.kind)])
        self.packed = {p: PIECE.pack(i, len(p)) for p, i in self.ids.items()}
        self.prefix, self.trim = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        self.normalize = Normalizer(unfolded(spec.get(2, b"")), self.prefix, self.trim, bool(spec.get(5, 1)))
        letters = {c: i for i, c in enumerate(sorted({c for p in self.ids if len(p) > 1 for c in p}), 1)}
        self.letter = np.zeros(0x110000, np.uint16)  # 0: in no piece of several characters
        self.letter[[ord(c) for c in letters]] = list(letters.values())
        self.joined = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        pairs = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.joined[[letters[p[0]] for p in pairs], [letters[p[1]] for p in pairs]] = True

    def _merged_short(self, stretch: str) -> list[str]:
        """Pieces of a short stretch, best-scored pair first, the left one among equals."""
        text, cost, none = list(stretch), self.cost.get, NO_PIECE
        pairs = [cost(a + b, none) for a, b in zip(stretch, stretch[1:])]
        while pairs and (best := min(pairs)) is not none:
            i = pairs.index(best)
            joined = text[i] = text[i] + text.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = cost(text[i - 1] + joined, none)
            if i < len(pairs):
                pairs[i] = cost(joined + text[i + 1], none)
        return text

    def _merged_long(self, stretch: str) -> list[str]:
        """The same by a queue of pairs, for stretches of any length."""
        text, cost = list(stretch), self.cost
        after, before = list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))

        def pair(left: int, right: int):
            joined = text[left] + text[right]
            if joined in cost:
                return cost[joined], left, right, joined
        queue = [x for i in range(len(text) - 1) if (x := pair(i, i + 1))]
        heapify(queue)
        while queue:
            _, left, right, joined = heappop(queue)
            if not text[left] or not text[right] or text[left] + text[right] != joined or after[left] != right:
                continue
            text[left], text[right] = joined, ""
            after[left] = after[right]
            if after[left] < len(text):
                before[after[left]] = left
                if found := pair(left, after[left]):
                    heappush(queue, found)
            if before[left] >= 0 and (found := pair(before[left], left)):
                heappush(queue, found)
        return [t for t in text if t]

    def __missing__(self, text: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        short, packed = len(text) <= self.short, self.packed
        pieces = self._merged_short(text) if short else self._merged_long(text)
        found = b"".join([packed[p] if p in packed else self._bytes(p) for p in pieces])
        if short:
            self[text] = found
        return found

    def _bytes(self, char: str) -> bytes:
        """A character without a piece, as byte pieces; the last one covers it."""
        found = [self.byte_id[b] for b in char.encode()]
        return b"".join(PIECE.pack(i, j == len(found)) for j, i in enumerate(found, 1))

    def parts(self, text: str) -> list[str]:
        """The text cut between all characters that stand side by side in no piece."""
        letter = self.letter[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        cuts = np.flatnonzero(~self.joined[letter[:-1], letter[1:]]) + 1
        at = [0, *cuts.tolist(), len(text)]
        return [text[i:j] for i, j in zip(at, at[1:])]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and the first and past-the-end source byte of each piece."""
        normal, source = self.normalize(text)
        found = np.frombuffer(b"".join(map(self.__getitem__, self.parts(normal))) if normal else b"", PACKED)
        ends = np.cumsum(found["covered"], dtype=np.int64)
        return found["id"], source[ends - found["covered"]], source[ends]

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids; byte pieces that are not UTF-8 become U+FFFD, byte by byte."""
        listed = ids.tolist()
        if listed and not self.trim and self.simple[ids].all():
            text = "".join(map(self.text_of.__getitem__, listed))
            return text[1:] if self.prefix and self.surface[listed[0]].startswith(MARK) else text
        out, held = [], bytearray()
        begun = False

        def release() -> None:
            at = 0
            while at < len(held):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(held[at:at + size].decode())
                        at += size
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    at += 1
            held.clear()
        for i in listed:
            if self.kind[i] == BYTE:
                held.append(self.byte_of[i])
                continue
            if held:
                release()
                begun = True
            if self.kind[i] == CONTROL:
                continue
            text = " ⁇ " if self.kind[i] == UNKNOWN else self.surface[i]
            if not begun and text.startswith(MARK) and (self.prefix or self.trim):
                text = text[1:]
                begun = not self.trim
            begun = begun or bool(text)
            out.append(text.replace(MARK, " "))
        release()
        return "".join(out)


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    with open(path, "rb") as file:
        return PieceModel(file.read())


ENCODED = "doc_id long, ids array<int>, begins array<int>, ends array<int>, decoded string"


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, begins and ends (source bytes of every piece), decoded (the text of the ids) for every row.

    ``model`` is the path of a merge model on every worker. A null text counts as empty and has no pieces; null and
    repeated doc_ids are rows like any other, other columns are ignored. Ill-formed UTF-8 counts as U+FFFD.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_model(model)
        for piece in pieces_of(batches, rows=2_000, size=4 << 20):
            doc_ids, raw = columns_of(piece, "doc_id", "text")
            found = [pieces.encode((t or b"").decode("utf-8", "replace")) for t in raw]
            decoded = [pieces.decode(f[0]) for f in found]
            offsets = pa.array(list(accumulate((len(f[0]) for f in found), initial=0)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[i] for f in found]).astype(np.int32)))
                     for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), *lists, pa.array(decoded, pa.string())],
                                             names=["doc_id", "ids", "begins", "ends", "decoded"])
    return texts(docs).mapInArrow(run, ENCODED)


@query("op13_pieces")
def op13_pieces(spark, folder):
    import public_tokenizers
    found = encode_documents(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))

    def digest(column):
        return F.sha2(F.concat_ws(",", F.col(column).cast("array<string>")), 256)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest("ids").alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
                        digest("ends").alias("ends_sha256"))
