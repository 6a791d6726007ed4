import hashlib
import io
import zipfile

from pyspark.sql import functions as F, types as T

from tabwright.llm.warc import (DATA, INDEX, ZipReader, ZipWriter, archive_and_read, open_shared, parse_record,
                                read_archives, record_bytes, with_duplicates, write_archives)
from tabwright.session import scratch_path

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                       T.StructField("html", T.StringType()), T.StructField("digest", T.StringType())])


class Memory(io.BytesIO):
    def size(self):
        return len(self.getvalue())

    def read_at(self, n, at):
        return self.getvalue()[at:at + n]


def test_own_archives_open_elsewhere():
    out = Memory()
    writer = ZipWriter(out)
    for name, parts in (("a/b.txt", [b"hello ", b"world"]), ("empty", [])):
        writer.begin(name)
        for p in parts:
            writer.write(p)
        writer.end()
    writer.close()
    with zipfile.ZipFile(out) as z:
        assert z.testzip() is None and z.read("a/b.txt") == b"hello world" and z.read("empty") == b""
    reader = ZipReader(out)
    assert out.read_at(11, reader.start("a/b.txt")) == b"hello world"


def test_foreign_archives_are_read():
    for force in (False, True):
        out = Memory()
        with zipfile.ZipFile(out, "w") as z:
            z.comment = b"some PK comment"
            with z.open("x.txt", "w", force_zip64=force) as f:
                f.write(b"one\ntwo\nthree")
            z.writestr("packed", b"z" * 1_000, zipfile.ZIP_DEFLATED)
        reader = ZipReader(out)
        assert list(reader.lines("x.txt", 4)) == [b"one", b"two", b"three"] and not reader.members["packed"].stored


def test_records_round_trip():
    payload = "é\r\n\r\nWARC/1.1\r\n".encode() * 3
    warc, http, body = parse_record(record_bytes(7, "http://a/\r\nb é", payload, "d" * 64, None))
    assert body == payload and warc["warc-type"] == "response" and warc["warc-target-uri"] == "http://a/%0D%0Ab%20é"
    warc, http, body = parse_record(record_bytes(8, None, payload, "d" * 64, 7))
    assert body == b"" and http["content-length"] == str(len(payload)) and warc["warc-refers-to"] == "<urn:page:7>"


def test_pages(spark):
    long, text = "é" * 60, "x" * 99
    rows = [(3, "u", long), (1, "u", long), (2, None, long), (5, "u", text), (4, "u", text), (6, "u", None), (7, "u", ""),
            (None, "u", long), (1, "u", long), (8, "u", "z" * 300_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)
    got = sorted(((r.page_id or -1), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                 for r in archive_and_read(pages).collect())

    def want(page, text, kind="response", first=None):
        data = (text or "").encode()
        return page, len(data), hashlib.sha256(data).hexdigest(), kind, first
    assert got == sorted([want(-1, long), want(1, long), want(1, long), want(2, long, "revisit", 1), want(3, long, "revisit", 1),
                          want(4, text), want(5, text), want(6, ""), want(7, ""), want(8, "z" * 300_000)])
    assert archive_and_read(pages.limit(0)).collect() == []


def test_small_blocks_read_the_same(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    archives = write_archives(with_duplicates(pages), scratch_path(spark, "warc-test"))
    whole = sorted(map(tuple, read_archives(archives).collect()), key=str)
    assert whole == sorted(map(tuple, read_archives(archives, block=1).collect()), key=str)
    path = archives.first().archive
    system, inner = open_shared(path)
    with zipfile.ZipFile(system.open_input_file(inner)) as z:
        assert z.testzip() is None and set(z.namelist()) == {DATA, INDEX}
        assert len(z.read(INDEX).splitlines()) == archives.where(F.col("archive") == path).first().n_records
