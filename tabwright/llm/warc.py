"""WARC records in ZIP archives, read back by ranges.

Writing: each task streams its records into one archive, as a stored member ``archive/data.warc``, with a second stored
member ``indexes/index.cdx`` that lists where each record lies. Sizes and offsets are written in ZIP64 fields.

Reading: the end record, the ZIP64 locator and the central directory give the members; the index member gives the
records; runs of neighbouring records are then fetched by one range read each and parsed where they were fetched.
Nothing is unpacked, and an archive is read by as many tasks as its records need.

Archives lie in a folder that all executors share; the paths may be of any kind that pyarrow opens (file, HDFS, S3).
A retried task writes a new file, and only the files that the finished task has named are read.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyarrow import fs

from tabwright.llm.common import columns_of, pieces_of, table, written
from tabwright.llm.registry import query
from tabwright.session import scratch_path

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
BIG = 0xFFFFFFFF
# Signatures of the archive format.
LOCAL, DESCRIPTOR, CENTRAL, END, END64, LOCATOR = (b"PK\3\4", b"PK\7\x08", b"PK\1\2", b"PK\5\6", b"PK\6\6", b"PK\6\7")


class ZipWriter:
    """Streams stored members to ``out``; sizes follow the data, in ZIP64 form."""

    def __init__(self, out):
        self.out, self.at, self.members = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.name, self.header, self.crc = name.encode(), self.at, 0
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(LOCAL + struct.pack("<HHHHHIIIHH", 45, 8, 0, 0, 33, 0, BIG, BIG, len(self.name), len(extra)))
        self._put(self.name + extra)
        self.start = self.at

    def write(self, data: bytes) -> None:
        self.crc = zlib.crc32(data, self.crc)
        self._put(data)

    def end(self) -> None:
        size = self.at - self.start
        self._put(DESCRIPTOR + struct.pack("<IQQ", self.crc, size, size))
        self.members.append((self.name, self.crc, size, self.header))

    def close(self) -> None:
        first = self.at
        for name, crc, size, header in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, header)
            self._put(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 8, 0, 0, 33, crc, BIG, BIG, len(name), len(extra),
                                            0, 0, 0, 0, BIG) + name + extra)
        size, n, end64 = self.at - first, len(self.members), self.at
        self._put(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, first))
        self._put(LOCATOR + struct.pack("<IQI", 0, end64, 1))
        self._put(END + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, BIG, BIG, 0))


@dataclass
class Member:
    name: str
    size: int
    header: int
    stored: bool


class ZipReader:
    """Members of an archive by range reads; ``file`` has size() and read_at(length, offset)."""

    def __init__(self, file):
        self.file = file
        total = file.size()
        tail_at = max(0, total - 65_557)
        tail = file.read_at(total - tail_at, tail_at)
        at = tail.rfind(END)
        if at < 0:
            raise ValueError("no end of central directory")
        entries, size, first = struct.unpack("<HII", tail[at + 10:at + 20])
        if at >= 20 and tail[at - 20:at - 16] == LOCATOR:
            where = struct.unpack("<Q", tail[at - 12:at - 4])[0]
            record = file.read_at(56, where)
            if record[:4] != END64:
                raise ValueError("no ZIP64 end of central directory")
            entries, size, first = struct.unpack("<QQQ", record[32:56])
        self.members = self._directory(file.read_at(size, first), entries)

    @staticmethod
    def _directory(data: bytes, entries: int) -> dict[str, Member]:
        members, at = {}, 0
        for _ in range(entries):
            if data[at:at + 4] != CENTRAL:
                raise ValueError("broken central directory")
            method, packed, size, n_name, n_extra, n_comment, header = struct.unpack(
                "<10xH8xIIHHH8xI", data[at:at + 46])
            name = data[at + 46:at + 46 + n_name].decode()
            extra, values = data[at + 46 + n_name:at + 46 + n_name + n_extra], [size, packed, header]
            while len(extra) >= 4:
                kind, length = struct.unpack("<HH", extra[:4])
                if kind == 1:  # holds just the values that are too large for their own field, in this order
                    wide = iter(struct.unpack(f"<{length // 8}Q", extra[4:4 + length // 8 * 8]))
                    values = [next(wide) if v == BIG else v for v in values]
                extra = extra[4 + length:]
            members[name] = Member(name, values[0], values[2], method == 0)
            at += 46 + n_name + n_extra + n_comment
        return members

    def start(self, name: str) -> int:
        """Offset of a stored member's first byte."""
        member = self.members[name]
        if not member.stored:
            raise ValueError(f"{name} is compressed")
        n_name, n_extra = struct.unpack("<26xHH", self.file.read_at(30, member.header))
        return member.header + 30 + n_name + n_extra

    def lines(self, name: str, step: int = 4 << 20) -> Iterator[bytes]:
        """Lines of a stored member, read in steps."""
        start, size, rest = self.start(name), self.members[name].size, b""
        for at in range(0, size, step):
            *whole, rest = (rest + self.file.read_at(min(step, size - at), start + at)).split(b"\n")
            yield from whole
        if rest:
            yield rest


def open_shared(path: str):
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner


def _clean(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
             f"WARC-Target-URI: {_clean(url)}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields (names in lower case) and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    def fields(raw: bytes) -> dict[str, str]:
        pairs = (line.partition(":") for line in raw.decode().split("\r\n")[1:])
        return {k.strip().lower(): v.strip() for k, _, v in pairs}
    warc = fields(head)
    if not head.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    http, _, payload = rest[:int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


def with_duplicates(pages: DataFrame, least: int = 100) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is the smallest page with the same payload of ``least`` bytes.

    Digests are counted in part before the shuffle; only those that occur twice are joined.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                       F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    own = own.withColumn("digest", F.sha2("payload", 256))
    large = own.where((F.length("payload") >= least) & F.col("page_id").isNotNull())
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    joined = own.join(first.select("digest", "first"), "digest", "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(F.col("first") < F.col("page_id"), F.col("first"))
                         .alias("refers_to"))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes one archive per task under ``folder``; returns (archive, n_records), fixed in the shared folder.

    Each record is a gzip member of its own inside the stored ZIP member, so a range still gives whole records.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = zipped = None
        index = []
        for piece in pieces_of(batches):
            for page_id, url, payload, digest, refers_to in zip(
                    *columns_of(piece, "page_id", "url", "payload", "digest", "refers_to")):
                if out is None:
                    path = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.zip"
                    system, inner = open_shared(path)
                    system.create_dir(inner.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(inner)
                    zipped = ZipWriter(out)
                    zipped.begin(DATA)
                data = gzip.compress(record_bytes(page_id, url, payload, digest, refers_to), mtime=0)
                index.append(f"{zipped.at - zipped.start} {len(data)}\n")
                zipped.write(data)
        if out is not None:
            zipped.end()
            zipped.begin(INDEX)
            for at in range(0, len(index), 10_000):
                zipped.write("".join(index[at:at + 10_000]).encode())
            zipped.end()
            zipped.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(index)], pa.int64())],
                                             names=["archive", "n_records"])
    return written(records.mapInArrow(run, "archive string, n_records long"), "warc-manifest")


def read_archives(archives: DataFrame, block: int = 4 << 20) -> DataFrame:
    """All records of the archives named in column ``archive``, as the fields of the query and the payload's own digest.

    Neighbouring records are read together up to ``block`` bytes.
    """
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in columns_of(batch, "archive")[0]:
                system, inner = open_shared(path)
                with system.open_input_file(inner) as file:
                    archive, rows, sizes, start = ZipReader(file), [], [], 0
                    base = archive.start(DATA)
                    for line in archive.lines(INDEX):
                        offset, size = map(int, line.split())
                        if sizes and offset + size - start > block:
                            rows.append((path, base + start, sizes))
                            sizes, start = [], offset
                        sizes.append(size)
                    rows.append((path, base + start, sizes))
                for row in rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row[0]]), pa.array([row[1]], pa.int64()), pa.array([row[2]], pa.list_(pa.int64()))],
                        names=["archive", "start", "sizes"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, sizes in zip(*columns_of(batch, "archive", "start", "sizes")):
                system, inner = open_shared(path)
                with system.open_input_file(inner) as file:
                    data, rows, at = file.read_at(sum(sizes), start), [], 0
                for size in sizes:
                    warc, http, payload = parse_record(gzip.decompress(data[at:at + size]))
                    at += size
                    revisit = warc["warc-type"] == "revisit"
                    def page(field):
                        number = warc.get(field, "").removeprefix("<urn:page:").removesuffix(">")
                        return int(number) if number else None
                    digest = warc["warc-payload-digest"].removeprefix("sha256:") if revisit else (
                        hashlib.sha256(payload).hexdigest())
                    rows.append((page("warc-record-id"), int(http["content-length"]) if revisit else len(payload), digest,
                                 warc["warc-type"], page("warc-refers-to"), warc["warc-target-uri"]))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[
                    "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])
    spread = archives.select("archive").mapInArrow(blocks, "archive string, start long, sizes array<long>")
    return spread.repartition("archive", "start").mapInArrow(
        records, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html) and reads all of them back.

    A null html is an empty payload. A row without page_id is a response that nothing refers to; rows that repeat the
    smallest page_id of a payload are all responses. Other columns are ignored. An empty table gives no archives.
    """
    archives = write_archives(with_duplicates(pages), scratch_path(pages.sparkSession, "warc"))
    return read_archives(archives)


@query("op3_warc", """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d""")
def op3_warc(spark, folder):
    return archive_and_read(table(spark, folder, "pages")).drop("url")
