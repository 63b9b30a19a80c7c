"""SentencePiece: parity with the library and exact round trips."""

import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from lexspark.llm import pieces

HARD = ["", " ", "  a  b ", "a\nb\t", "▁a▁ b", "ﬁ①日本語😀 é", "x<unk>y<s>", "\x00\x01", "trail ", "y" * 3000, "the of and " * 2000]


@pytest.fixture(scope="module")
def encoder():
    return pieces._encoder(pieces.piece_model())


def test_parity(encoder):
    want = encoder.reference.encode(HARD)
    assert encoder.encode(HARD) == want
    assert [e.ids for e in encoder.whole.encode_batch(HARD, add_special_tokens=False)] == want
    assert encoder.decode(want) == encoder.reference.decode(want)


def test_every_text_of_a_batch_has_the_library_ids(encoder):
    """Long runs of spaces, wherever they stand: 128 texts go before them, so that no sample meets them."""
    runs = [" " * n for n in range(1, 70)] + ["a\n" + " " * n + "b" for n in range(1, 70)] + ["a ", " a", "▁" * 20]
    texts = ["plain text"] * 129 + [t for t in runs for _ in range(2)]
    got = [x for low in range(0, len(texts), 256) for x in encoder.encode(texts[low : low + 256])]
    assert got == encoder.reference.encode(texts)


@pytest.mark.parametrize("fallback", [True, False])
def test_unigram(fallback):
    """A small unigram model written as a protobuf by hand; nothing is trained."""

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    field = lambda i, data: number(i << 3 | 2) + number(len(data)) + data
    float32 = lambda i, x: number(i << 3 | 5) + np.array([x], "<f4").tobytes()
    whole = lambda i, n: number(i << 3) + number(n)
    vocab = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] * fallback
    vocab += [("▁a", -1.0, 1), ("▁", -2.0, 1), ("a", -2.5, 1), ("b", -2.6, 1), ("ab", -2.0, 1), ("▁ab", -2.2, 1)]
    data = b"".join(field(1, field(1, p.encode()) + float32(2, s) + whole(3, k)) for p, s, k in vocab)
    data += field(2, whole(3, 1) + whole(4, len(vocab)) + whole(35, int(fallback))) + field(3, field(1, b"identity") + whole(3, 1) + whole(4, 0))
    own = pieces.Encoder(data)
    assert own.model.unigram
    texts = ["ab a b", "aab", "b", "abé", ""]
    assert own.encode(texts) == sentencepiece.SentencePieceProcessor(model_proto=data).encode(texts)


def test_columns(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*HARD, None])], "doc_id long, text string").withColumn("piece_ids", F.lit("clash"))
    both = pieces.decode_pieces(pieces.encode_pieces(rows, pieces.piece_model()), pieces.piece_model())
    got = {r.doc_id: r for r in both.collect()}
    assert len(got) == len(HARD) + 1 and bytes(got[len(HARD)].piece_ids) == b"" and got[len(HARD)].decoded == ""
    own = sentencepiece.SentencePieceProcessor(model_file=pieces.piece_model())
    for i, t in enumerate(HARD):
        assert np.frombuffer(got[i].piece_ids, "<u4").tolist() == own.encode(t)
    assert pieces.encode_pieces(rows.limit(0), pieces.piece_model()).count() == 0


def test_query(spark, data):
    """Ids and texts of all documents against the sentencepiece library."""
    own = sentencepiece.SentencePieceProcessor(model_file=pieces.piece_model())
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = pieces.op6_pieces(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = own.encode(texts[r.doc_id])
        assert (r.n_pieces, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert r.decoded_chars == len(own.decode(ids)) and r.round_trip == (own.decode(ids) == texts[r.doc_id])
    assert all(r.round_trip for r in rows)


def test_trimmed_spaces():
    """A model that trims blanks goes through the rebuilt normaliser."""
    with open(pieces.piece_model(), "rb") as f:
        data = f.read()
    own = pieces.Encoder(data)
    trimmed = pieces.PieceModel(*(getattr(own.model, f) if f != "trim_spaces" else True for f in own.model.__dataclass_fields__))
    whole = pieces.build(trimmed)
    for text in ("  a   b ", "a b", " "):
        assert whole.encode(text, add_special_tokens=False).ids == own.reference.encode(" ".join(text.split()))
