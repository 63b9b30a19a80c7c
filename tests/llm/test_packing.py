"""Packing: every id once, no window over capacity, little padding."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexspark.llm import packing


@pytest.mark.parametrize("n, windows", [(0, 3), (1, 1), (5, 1), (3, 7), (200, 20), (300, 64)])
def test_differencing(n, windows):
    rng = random.Random(n)
    sizes = [rng.randint(1, 256) for _ in range(n)]
    where = packing.differencing(sizes, windows)
    assert len(where) == n and all(0 <= w < windows for w in where)
    if n >= 3 * windows > 3:
        sums = np.bincount(where, weights=sizes, minlength=windows)
        assert sums.max() - sums.min() < 64


def test_windows_rise_with_capacity():
    n, where = packing.windows_for([600, 600, 600], 1024)
    assert n == 3 and sorted(where) == [0, 1, 2]


def check(spark, rows, **options):
    exact = Tokenizer.from_file(packing.byte_bpe())
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)), packing.byte_bpe(), **options).collect()
    by = {}
    for p in got:
        by.setdefault(p.doc_id, []).append(p)
    for key, text in rows:
        ids = [*exact.encode(text or "", add_special_tokens=False).ids, 0]
        pieces = sorted(by[key], key=lambda p: p.start)
        assert [p.start for p in pieces] == [0, *np.cumsum([p.length for p in pieces])[:-1].tolist()]
        assert b"".join(bytes(p.ids) for p in pieces) == np.array(ids, "<u4").tobytes()
        assert {p.doc_tokens for p in pieces} == {len(ids)}
    filled = {}
    for p in sorted(got, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == filled.get(p.sequence_id, 0)
        filled[p.sequence_id] = p.offset + p.length
    assert max(filled.values()) <= options.get("capacity", 1024)
    return filled


def test_pieces(spark):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice(["the", "Être", "naïve", "x", "日本", "12"]) for _ in range(n))
    rows = [(i, text(rng.randrange(400))) for i in range(60)] + [(100, None), (101, ""), (102, "<|endoftext|>a"), (103, text(6000))]
    check(spark, rows)
    check(spark, rows, capacity=64, piece=16, block=20)


def test_little_padding_and_query(spark, data):
    got = packing.op5_pack(spark, data)
    again = {tuple(r) for r in packing.op5_pack(spark, data).collect()}
    rows = got.collect()
    assert {tuple(r) for r in rows} == again
    sizes = {}
    for r in rows:
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
    assert sum(sizes.values()) / (1024 * len(sizes)) > 0.97


def test_all_pieces_have_the_library_ids(spark):
    sf = "/root/testdata/sf0.01"
    exact = Tokenizer.from_file(packing.byte_bpe())
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    ids = {r.doc_id: [*e.ids, 0] for r, e in zip(docs, exact.encode_batch([r.text or "" for r in docs], add_special_tokens=False))}
    covered = {key: 0 for key in ids}
    for r in packing.op5_pack(spark, sf).collect():
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id])
        covered[r.doc_id] += r.length
    assert covered == {key: len(x) for key, x in ids.items()}


def test_white_space_and_added_tokens():
    """Every character below U+3100 next to letters and blanks, and added tokens after runs of blanks."""
    odd = [t for cp in range(0x3100) for c in [chr(cp)] for t in (f"a{c}b", f"a {c} b", f"a {c}{c}b{c}", f" {c}", f"x {c}Ġ {c}'s")]
    odd += ["x  <|endoftext|>  y", "<|endoftext|>", "a<|endoftext|>b", "<|endoftext", "'s 't''s x's", "\n" * 100_000, " " * 100_000, "z" * 100_000, ""]
    exact = Tokenizer.from_file(packing.byte_bpe())
    want = [np.array(e.ids, "<u4").tobytes() for e in exact.encode_batch(odd, add_special_tokens=False)]
    assert packing.Encoder(packing.byte_bpe()).encode(odd) == want
    small = packing.Encoder(packing.byte_bpe(), cached=10)
    assert [x for low in range(0, len(odd), 500) for x in small.encode(odd[low : low + 500])] == want


def test_letters_and_signs():
    """Words are cut after the letters that they begin with; what was met since the last half of the words stays known."""
    rng = random.Random(5)
    parts = [*"aZéſßÿ×÷ªµ'’,.-_`{~\x7f \n\x1c\xa01²٣日\u0301\U0001f600\0Ġƀǅ\u200bİ", "  ", "'s", " and", "x's,", "word's-end"]
    odd = ["".join(rng.choices(parts, k=rng.randrange(1, 40))) for _ in range(4000)] + ["a,'" * 30_000, "," * 100_000, "a" * 3000 + "é,"]
    exact = Tokenizer.from_file(packing.byte_bpe())
    want = [np.array(e.ids, "<u4").tobytes() for e in exact.encode_batch(odd, add_special_tokens=False)]
    small = packing.Encoder(packing.byte_bpe(), cached=1000)
    assert [x for low in range(0, len(odd), 50) for x in small.encode(odd[low : low + 50])] == want
    assert small.encode([" kept"] * 2) == small.encode([" kept"]) * 2
    small.known, small.before = {}, {" kept": b"12345678"}
    assert small.encode([" kept other"])[0].startswith(b"12345678") and small.known[" kept"] == b"12345678"
    small.forget()
    assert not small.known and not small.before


def test_a_million_line_feeds(spark):
    got = packing.pack_documents(spark.createDataFrame([(1, "\n" * 1_000_000), (2, None)], "doc_id long, text string"), packing.byte_bpe())
    assert got.where("doc_id = 1").agg(F.sum("length")).first()[0] == 500_001


def test_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), packing.byte_bpe()).count() == 0
