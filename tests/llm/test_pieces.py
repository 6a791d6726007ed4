import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tabwright.llm.pieces import PieceModel, encode_documents, op13_pieces, piece_model, wire_fields

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
ALPHABETS = ["ab the in er  ", "  \n\t▁x1.!", "éüßñ日本語кот😀é 　", "<s></s><0x0A>%&#=_-09af\\/", "\x00\x01  "]


def some_texts(n):
    rng = random.Random(4)
    return ["".join(rng.choices(rng.choice(ALPHABETS), k=rng.randint(0, 60))) for _ in range(n)] + [
        "", " ", "  a  b  ", "▁", "▁▁ x", "a" * 3_000, " " * 300, "ab" * 700 + "é", "ﬁ ①  Ａ", "á ｶﾞ", "\n\n"]


def assert_same(model, library, texts):
    for text in texts:
        ids, begins, ends = model.encode(text)
        want = library.encode(text, return_type="proto").pieces
        assert ids.tolist() == [p.id for p in want], text
        assert list(zip(begins.tolist(), ends.tolist())) == [(p.begin, p.end) for p in want], text
        assert model.decode(ids) == library.decode(ids.tolist()), text


def test_ids_spans_and_decoding_match_the_library():
    assert_same(piece_model(MODEL), LIBRARY, some_texts(2_500))


def test_bounded_table_changes_nothing():
    with open(MODEL, "rb") as file:
        assert_same(PieceModel(file.read(), most=20, short=5), LIBRARY, some_texts(200))


def test_any_ids_decode_like_the_library():
    rng, model = random.Random(5), piece_model(MODEL)
    for _ in range(2_000):
        ids = [rng.choice((rng.randrange(32_000), rng.randrange(259))) for _ in range(rng.randint(0, 12))]
        assert model.decode(np.array(ids, np.int32)) == LIBRARY.decode(ids)


@pytest.mark.parametrize("prefix", [0, 1])
@pytest.mark.parametrize("trim", [0, 1])
def test_compiled_character_map(prefix, trim):
    """The model with another character map and other white-space options, against the library with the same."""
    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])
    rules = dict(wire_fields(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_normalizer_spec()))[2]
    spec = b"\x12" + number(len(rules)) + rules + bytes([24, prefix, 32, trim])
    with open(MODEL, "rb") as file:
        data = file.read() + b"\x1a" + number(len(spec)) + spec
    assert_same(PieceModel(data), sentencepiece.SentencePieceProcessor(model_proto=data), some_texts(600))


def test_other_kinds_of_models_are_refused():
    piece = b"\x0a\x01a" + b"\x18\x04"
    with pytest.raises(ValueError):
        PieceModel(b"\x0a" + bytes([len(piece)]) + piece)


def test_query_matches_the_library(spark, small):
    import hashlib

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()
    rows = {r.doc_id: r for r in op13_pieces(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = LIBRARY.encode(d.text)
        r = rows[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids)))


def test_odd_rows(spark, make_docs):
    long = "word  is\n" * 30_000 + "x" * 50_000
    docs = make_docs([(1, None), (2, ""), (None, "a b"), (3, "é😀"), (3, "é😀"), (4, long)]).withColumn("ids", F.lit("clash"))
    got = {(r.doc_id, tuple(r.ids[:9]), r.decoded, tuple(zip(r.begins, r.ends))[:9]) for r in encode_documents(docs, MODEL).collect()}
    want = set()
    for i, t in [(1, ""), (2, ""), (None, "a b"), (3, "é😀"), (4, long)]:
        p = LIBRARY.encode(t, return_type="proto").pieces
        want.add((i, tuple(x.id for x in p[:9]), LIBRARY.decode([x.id for x in p]), tuple((x.begin, x.end) for x in p[:9])))
    assert got == want
    assert encode_documents(docs, MODEL).count() == 6
    assert encode_documents(make_docs([]), MODEL).collect() == []
