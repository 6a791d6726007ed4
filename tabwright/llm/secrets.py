"""Secret scanning through nested encodings.

A worklist starts with the text itself. Each layer is scanned for secrets, then every way to unwrap it is tried:
percent-encoding, backslash escapes (code points, octal and those of JSON) and character references over the whole layer,
base64 runs one by one (joined over line breaks, at all four alignments), and compressed data (gzip, zlib) anywhere inside them.
The ASCII stretches of what comes out, those of base64 also in UTF-16, are new layers, until nothing new comes out; a layer that was seen at the same place before is not followed, which ends cycles. Every character of a layer knows the span of the original text it came from, so a
hit at any depth is reported as a span of the original.
"""

from __future__ import annotations

import binascii
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, tee

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabwright.llm.common import columns_of, pieces_of, table, texts
from tabwright.llm.registry import query

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # [0-9a-f]+ of 24 or more
KINDS = ("assign", "access", "hex")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|((?:\\u[0-9A-Fa-f]{4})+)|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})"
                    r"|\\([0-3][0-7]{2})|\\([bfnrt/\"'\\])")
# The short escapes of JSON and the character references that XML predefines.
SHORT = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "/": "/", '"': '"', "'": "'", "\\": "\\"}
NAMED = {"quot": '"', "apos": "'", "lt": "<", "gt": ">"}  # and amp, of which a chain becomes one character
REFERENCE = re.compile(r"&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});|&(quot|apos|lt|gt);|&(?:amp;)+")
CODE = "A-Za-z0-9+/_-"
BASE64 = re.compile(rf"(?<![{CODE}])[{CODE}]++(?:(?:[\x20\t]*+\r?\n[\x20\t]*+[{CODE}]++)++|(?<=[{CODE}]{{16}}))={{0,2}}")
LINE_BREAK = re.compile(r"\s+")
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")  # gzip, zlib without a preset dictionary
# All patterns above are ASCII and the shortest secret, or code of one, has 12 characters.
STRETCH = re.compile(rb"[\t-\r\x20-\x7e]{12,}")
WIDE = re.compile(rb"(?:[\t-\r\x20-\x7e]\0){12,}"), re.compile(rb"(?:\0[\t-\r\x20-\x7e]){12,}")  # the same in UTF-16
ASCII_BYTES = bytes([*range(9, 14), *range(32, 127)])
RUN_BYTES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-= \t\r\n"
# Decompressed data comes in pieces and is scanned in windows that overlap, extended to the start of a run cut by their end.
PIECE, WINDOW, OVERLAP, LONGEST = 1 << 20, 4 << 20, 64 << 10, 32 << 20


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, leftmost and non-overlapping within a kind."""
    found, low = [], text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


@dataclass
class Layer:
    """Decoded text; character i came from the original's ``start[i]`` to ``end[i]``. None stands for the original."""

    text: str
    start: np.ndarray | None = None
    end: np.ndarray | None = None

    def span(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.start is None else (int(self.start[a:b].min()), int(self.end[a:b].max()))


def _rewritten(layer: Layer, edits: list[tuple[int, int, str]]) -> Layer:
    """The layer with each [a, b) replaced; all characters of a replacement map to the whole of what they replace."""
    texts_, starts, ends, at = [], [], [], 0

    def keep(a: int, b: int) -> None:
        texts_.append(layer.text[a:b])
        starts.append(np.arange(a, b) if layer.start is None else layer.start[a:b])
        ends.append(np.arange(a + 1, b + 1) if layer.end is None else layer.end[a:b])
    for a, b, new in edits:
        keep(at, a)
        lo, hi = layer.span(a, b)
        texts_.append(new)
        starts.append(np.full(len(new), lo))
        ends.append(np.full(len(new), hi))
        at = b
    keep(at, len(layer.text))
    return Layer("".join(texts_), np.concatenate(starts), np.concatenate(ends))


def _percent(layer: Layer) -> Iterator[Layer]:
    """Each byte triple becomes its character; runs that are not UTF-8 are read as Latin-1."""
    edits = []
    for m in PERCENT.finditer(layer.text):
        raw = bytes.fromhex(m[0].replace("%", ""))
        try:
            chars = raw.decode()
        except UnicodeDecodeError:
            chars = raw.decode("latin-1")
            widths = [1] * len(raw)
        else:
            widths = [len(c.encode()) for c in chars]
        at = m.start()
        for c, w in zip(chars, widths):
            edits.append((at, at + 3 * w, c))
            at += 3 * w
    if edits:
        yield _rewritten(layer, edits)


def _escapes(layer: Layer) -> Iterator[Layer]:
    edits = []
    for m in ESCAPE.finditer(layer.text):
        if m[2]:
            chars = bytes.fromhex(m[2].replace("\\u", "")).decode("utf-16-be", "replace")
            at = m.start()
            for c in chars:
                width = 6 * len(c.encode("utf-16-be")) // 2
                edits.append((at, at + width, c))
                at += width
        elif m[6]:
            edits.append((m.start(), m.end(), SHORT[m[6]]))
        else:
            point = int(m[5], 8) if m[5] else int(m[1] or m[3] or m[4], 16)
            if point < 0x110000 and not 0xD800 <= point < 0xE000:
                edits.append((m.start(), m.end(), chr(point)))
    if edits:
        yield _rewritten(layer, edits)


def _references(layer: Layer) -> Iterator[Layer]:
    edits = []
    for m in REFERENCE.finditer(layer.text):
        point = int(m[1], 16) if m[1] else int(m[2]) if m[2] else ord(NAMED[m[3]] if m[3] else "&")
        if point < 0x110000 and not 0xD800 <= point < 0xE000:
            edits.append((m.start(), m.end(), chr(point)))
    if edits:
        yield _rewritten(layer, edits)


def _members(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The content of all gzip or zlib members, piece by piece, up to the first damage."""
    unpack = zlib.decompressobj(47)
    try:
        for piece in pieces:
            while piece:
                out = unpack.decompress(piece, PIECE)
                if out:
                    yield out
                piece = unpack.unconsumed_tail
                if unpack.eof:
                    piece, unpack = unpack.unused_data, zlib.decompressobj(47)
        if out := unpack.flush():
            yield out
    except zlib.error:
        return


def _peeled(pieces: Iterable[bytes]) -> Iterator[bytes] | None:
    """What lies under all levels of gzip and zlib, piece by piece; None if there is no such level.

    A level that starts as one above it did is not opened, which ends data that unpacks to itself.
    """
    heads: set[bytes] = set()
    pieces = iter(pieces)
    while True:
        head = next(pieces, b"")
        pieces = chain([head], pieces)
        if not PACKED.match(head) or head in heads:
            break
        pieces, closed = tee(pieces)
        opened = _members(pieces)
        first = next(opened, None)
        if first is None:
            pieces = closed
            break
        del closed
        heads.add(head)
        pieces = chain([first], opened)
    return pieces if heads else None


def _end_of_packed(raw: bytes, at: int) -> int | None:
    """Where the members that start at ``at`` end; None if the first is damaged or cut off."""
    end = None
    while PACKED.match(raw, at):
        unpack, piece = zlib.decompressobj(47), raw[at:]
        try:
            while not unpack.eof and piece:
                unpack.decompress(piece, PIECE)
                piece = unpack.unconsumed_tail
        except zlib.error:
            return end
        if not unpack.eof:
            return end
        end = at = len(raw) - len(unpack.unused_data)
    return end


def _stretches(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The ASCII stretches of a stream; longer ones than a window come as overlapping parts."""
    held, limit = b"", WINDOW
    for piece in pieces:
        held += piece
        if len(held) < limit:
            continue
        done = keep = len(held.rstrip(ASCII_BYTES))
        if len(held) - keep > WINDOW // 2:
            done, keep = len(held), min(len(held) - OVERLAP, max(keep, len(held.rstrip(RUN_BYTES))))
            if len(held) > LONGEST:
                keep = max(keep, len(held) - OVERLAP)
            elif len(held) - keep > WINDOW // 2:
                limit = 2 * len(held)
                continue
        yield from (m[0] for m in STRETCH.finditer(held, 0, done))
        held, limit = held[keep:], WINDOW
    yield from (m[0] for m in STRETCH.finditer(held))


def _base64(layer: Layer, most: int | None) -> Iterator[Layer]:
    """Layers of each run, decoded from its first four characters on: one of these fits wherever in the run the code starts."""
    for m in BASE64.finditer(layer.text):
        parts, cuts, gaps = [], [0], []
        at = m.start()
        for part in LINE_BREAK.split(m[0].rstrip("=")):
            at = layer.text.index(part, at)
            gaps.append(at - cuts[-1])
            parts.append(part)
            cuts.append(cuts[-1] + len(part))
            at += len(part)
        token = "".join(parts).translate({45: 43, 95: 47})
        if len(token) < 16:
            continue
        gaps, cuts = np.array(gaps), np.array(cuts[:-1])

        def place(i: np.ndarray) -> np.ndarray:
            """Characters of the token as characters of the layer."""
            return i + gaps[np.searchsorted(cuts, i, "right") - 1]
        for shift in range(4):
            size = len(token) - shift
            size -= size % 4 == 1
            raw = binascii.a2b_base64(token[shift:shift + size] + "=" * (-size % 4))
            for found, width, letter in chain(((f, 1, 0) for f in STRETCH.finditer(raw)), (
                    (f, 2, i) for i, wide in enumerate(WIDE) if b"\0" in raw for f in wide.finditer(raw))):
                byte = np.arange(found.start(), found.end() + 1, width)  # three bytes come from four characters
                first = place(shift + byte[:-1] * 4 // 3)
                last = place(shift + -(-byte[1:] * 4 // 3) - 1)
                yield Layer(found[0][letter::width].decode("ascii"), first if layer.start is None else layer.start[first],
                            last + 1 if layer.end is None else layer.end[last])
            done = 0
            for found in PACKED.finditer(raw):
                if found.start() < done or (pieces := _peeled([raw[found.start():]])) is None:
                    continue
                if most is not None:
                    whole = b"".join(_first(pieces, most + 1))
                    if len(whole) > most:
                        continue
                    pieces = [whole]
                end = _end_of_packed(raw, found.start())
                done = end or 0
                last = m.end() if end in (None, len(raw)) else int(place(np.array([shift - (-end * 4 // 3) - 1]))[0]) + 1
                lo, hi = layer.span(int(place(np.array([shift + found.start() * 4 // 3]))[0]), last)
                for part in _stretches(pieces):
                    yield Layer(part.decode("ascii"), np.broadcast_to(lo, len(part)), np.broadcast_to(hi, len(part)))


def _first(pieces: Iterable[bytes], size: int) -> Iterator[bytes]:
    for piece in pieces:
        yield piece
        size -= len(piece)
        if size <= 0:
            return


def _unwrapped(layer: Layer, most: int | None) -> Iterator[Layer]:
    if "%" in layer.text:
        yield from _percent(layer)
    if "\\" in layer.text:
        yield from _escapes(layer)
    if "&" in layer.text:
        yield from _references(layer)
    yield from _base64(layer, most)


def scan(text: str, most: int | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, each (start, kind number, end), sorted.

    Decompressed data of any size is scanned window by window. ``most``, if given, leaves out what is larger once unpacked.
    """
    base = find_secrets(text)
    spans, seen, work = set(base), set(), [_unwrapped(Layer(text), most)]
    while work:
        new = next(work[-1], None)
        if new is None:
            work.pop()
            continue
        mark = hashlib.blake2b(new.text.encode("utf-8", "replace"), digest_size=16).digest(), *(
            (int(new.start.min()), int(new.end.max())) if new.text else (0, 0))
        if new.text and mark not in seen:
            seen.add(mark)
            for a, kind, b in find_secrets(new.text):
                lo, hi = new.span(a, b)
                spans.add((lo, kind, hi))
            work.append(_unwrapped(new, most))
    return base, sorted(spans)


def written_out(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Secrets of every row of ``docs`` (doc_id, text): counts of the base patterns, their digest, and all spans.

    A null text is an empty one. Null and repeated doc_ids are rows like any other; other columns are ignored.
    """
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces_of(batches):
            rows = []
            for doc_id, raw in zip(*columns_of(piece, "doc_id", "text")):
                base, spans = scan((raw or b"").decode("utf-8", "replace"))
                kinds = [k for _, k, _ in base]
                rows.append((doc_id, kinds.count(0), kinds.count(1), kinds.count(2),
                             hashlib.sha256(written_out(base).encode()).hexdigest(), written_out(spans), len(spans)))
            kinds_ = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds_)], names=names)
    return texts(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
                                       "spans string, n_spans long")


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret, overlapping ones merged, replaced by ``mark``; n_chars follows, all else stays.

    A null text stays null. Texts without secrets are unchanged.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces_of(batches):
            at, out = piece.schema.get_field_index("text"), []
            for text in piece.column(at).to_pylist():
                if text is not None:
                    parts, done = [], 0
                    for a, _, b in scan(text)[1]:
                        if a >= done:
                            parts += [text[done:a], mark]
                        done = max(done, b)
                    text = "".join(parts) + text[done:]
                out.append(text)
            columns = list(piece.columns)
            columns[at] = pa.array(out, piece.schema.field(at).type)
            n = piece.schema.get_field_index("n_chars")
            if n >= 0:
                columns[n] = pa.array([old if t is None else len(t) for t, old in zip(out, columns[n].to_pylist())],
                                      piece.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(columns, schema=piece.schema)
    return docs.mapInArrow(run, docs.schema)


@query("op2_secrets")
def op2_secrets(spark, folder):
    return scan_secrets(table(spark, folder, "documents"))
