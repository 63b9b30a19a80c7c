"""Fingerprints: peeling against set differences, neighbours against a sorted list."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.llm import fingerprints as G


@pytest.mark.parametrize("shared, left, right", [(0, 0, 0), (50, 0, 0), (100, 3, 2), (0, 500, 1), (1000, 200, 300)])
def test_peeling(shared, left, right):
    rng = np.random.default_rng(left)
    keys = rng.integers(1, 1 << 63, shared + left + right, np.uint64)
    sets = [np.sort(keys[: shared + left]), np.sort(np.r_[keys[:shared], keys[shared + left :]])]
    for (only_a, only_b), (x, y) in zip(G.differences(sets, [(0, 1), (1, 0), (0, 0)]), [(left, right), (right, left), (0, 0)]):
        assert (len(only_a), len(only_b)) == (x, y)
    only_a, only_b = G.differences(sets, [(0, 1)])[0]
    assert set(only_a.tolist()) == set(keys[shared : shared + left].tolist())
    assert set(only_b.tolist()) == set(keys[shared + left :].tolist())


def test_a_small_sketch_sticks_and_turns_are_taken():
    rng = np.random.default_rng(0)
    sets = [rng.integers(1, 1 << 63, n, np.uint64) for n in (400, 0, 30, 3)]
    *_, done, held = G.Sketches(sets, 24).minus([0, 3, 1], [1, 1, 1]).peel()
    assert done.tolist() == [False, True, True] and held[0] == G.FULL and held[2] == 0
    found = G.differences(sets, [(i, j) for i in range(4) for j in range(4)], most_cells=60)
    assert [len(a) for a, _ in found] == [0 if i == j else len(sets[i]) for i in range(4) for j in range(4)]


def passages(text):
    """By the docstring, character by character, with Python's numbers."""
    grams = []
    for i in range(len(text)):
        h = 0
        for j, c in enumerate((0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1)):
            h += (ord(text[i - j]) + 1 if i >= j else 1) * c
        h &= 0xFFFFFFFF
        h ^= h >> 15
        h = h * 0x2C1B3C6D & 0xFFFFFFFF
        grams.append(h ^ h >> 12)
    out, at = [], 0
    for i in range(len(text)):
        if text[i] == "\n" or grams[i] == min(grams[max(0, i - G.REACH) : i + G.REACH + 1]) or i == len(text) - 1:
            out.append(text[at : i + 1])
            at = i + 1
    return out


def brute_likeness(a, b):
    a, b = Counter(passages(a)), Counter(passages(b))
    either = sum((a | b).values())
    return sum((a & b).values()) / either if either else 1.0


HARD = ["", "a", "ab\n\ncd\n", "\n" * 300, "z" * 500, "ab " * 200, "été \U0001f600 日本語" * 30, "\0\0a\0", "One Two"]


def test_passages_and_their_repetitions():
    for text, keys in zip(HARD, G.digests(HARD)):
        assert len(keys) == len(passages(text)) == len(set(keys.tolist()))
    alone = [k.tolist() for t in HARD for k in G.digests([t])]
    assert alone == [k.tolist() for k in G.digests(HARD)] == [k.tolist() for k in G.digests(HARD, block=3)]


def test_an_edit_changes_few_passages():
    rng = random.Random(3)
    text = "\n".join(" ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(60)) for _ in range(5))
    for place in (0, 1, 100, 239, 240, 241, 700, len(text)):
        other = text[:place] + "x" + text[place:]
        assert brute_likeness(text, other) > 0.95
    assert brute_likeness(text[:240], text[:241]) > 0.9


def test_long_texts(spark):
    texts = [(1, "\n" * 400_000, "\n" * 400_001), (2, "word " * 60_000, "word " * 60_000 + "x"), (3, None, "")]
    rows = {r.doc_id: r for r in G.compare_versions(spark.createDataFrame(texts, "doc_id long, text string, other string"), "text", ["other"]).collect()}
    assert rows[1].other_gone == 0 and rows[1].other_new == 1 and rows[2].other_likeness > 0.99 and rows[3].other_likeness == 1


def test_printed_fingerprints_tell_small_differences(spark):
    a, b = "".join(f"line {i} of a text\n" for i in range(50)), "".join(f"line {i} of a text\n" for i in range(49))
    rows = spark.createDataFrame([(a, b)], "text string, other string").withColumn("other_new", F.lit("clash"))
    row = G.compare_versions(rows, "text", ["other"]).first()
    (n, x), (m, y) = G.parsed(row.text_fingerprint), G.parsed(row.other_fingerprint)
    assert (n, m) == tuple(map(len, G.digests([a, b])))
    both = Sketches2(x, y)
    _, _, signs, done, _ = both.minus([0], [1]).peel()
    assert done.all() and (signs > 0).sum() == row.other_gone and (signs < 0).sum() == row.other_new


def Sketches2(x, y):
    out = G.Sketches([], x.cells)
    out.n = 2
    out.counts, out.keys, out.checks = (np.concatenate(p) for p in ((x.counts, y.counts), (x.keys, y.keys), (x.checks, y.checks)))
    return out


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    out = []
    for i, (key, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        q = len(text) // 4
        out.append((key, len(text), hashlib.sha256((text[: len(text) - q] + after[:q]).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("n", [1, 2, 90])
def test_neighbours(spark, tmp_path, n):
    rng = random.Random(n)
    rows = [(rng.randrange(10**6), " ".join(rng.choices(["été", "b.", "c"], k=rng.randrange(60)))) for _ in range(n - 1)] + [(5, None)]
    rows += rows[:1] * (n > 2)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in G.op8_fingerprints(spark, str(tmp_path)).collect())
    assert got == sorted(expected(rows))


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert G.op8_fingerprints(spark, str(tmp_path)).count() == 0


def test_likeness(spark, data):
    rows = {r.doc_id: r for r in G.op8_fingerprints(spark, data).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    ids = sorted(texts)
    for key, after in [*zip(ids, ids[1:] + ids[:1])][:60]:
        text, q = texts[key], len(texts[key]) // 4
        edited = text[: len(text) - q] + texts[after][:q]
        assert abs(rows[key].near_edited - brute_likeness(text, edited)) < 1e-12
        assert abs(rows[key].near_next - brute_likeness(text, texts[after])) < 1e-12
    assert sum(r.near_edited > r.near_next for r in rows.values()) > 0.97 * len(rows)
    seen = {}
    for key, r in rows.items():
        assert seen.setdefault(texts[key], r.fingerprint) == r.fingerprint


def test_repeated_and_null_ids(spark, tmp_path):
    rows = [(None, "b"), (None, "a"), (3, "same"), (3, "same"), (7, "last")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r.doc_id), r.n_chars, r.near_next) for r in G.op8_fingerprints(spark, str(tmp_path)).collect())
    assert [g[:2] for g in got] == [("3", 4), ("3", 4), ("7", 4), ("None", 1), ("None", 1)] and sum(g[2] == 1 for g in got) == 1
