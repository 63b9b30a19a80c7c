"""Removal of repeated bytes against a dictionary of all 200-byte strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lexspark.llm import repeats
from lexspark.llm.repeats import SPAN


def brute(texts):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + SPAN] for d in data for i in range(len(d) - SPAN + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - SPAN + 1):
            if seen[d[i : i + SPAN]] > 1:
                gone[i : i + SPAN] = True
        spans = int((gone[:-1] & ~np.roll(gone, 1)[:-1]).sum())
        kept = bytes(c for c, g in zip(d, gone) if not g)
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def words(rng, n, base=400):
    return " ".join("".join(rng.choices("abcdeé", k=rng.randrange(2, 7))) for _ in range(n))


def corpus(seed):
    rng = random.Random(seed)
    passages = [words(rng, n) for n in (30, 45, 60, 90, 200)]
    texts = [words(rng, rng.randrange(5, 200)) for _ in range(30)]
    texts += [words(rng, 20) + p + words(rng, 20) for p in passages for _ in range(3)]
    whole = words(rng, 300)
    for _ in range(12):  # near copies: an edit at a chance place
        at = rng.randrange(len(whole))
        texts.append(whole[:at] + rng.choice(["x", "", "new words "]) + whole[at + 1 :])
    texts += [whole, whole, "a" * 700, "a" * 150, "b" * 200, "ab" * 300, "x" + "y" * 199, "x" + "y" * 199 + "z"]
    texts += [p + p for p in passages] + [None, "", " ", passages[0] + "é" + passages[1], "\0" * 450]
    return texts


def checked(df, texts):
    got = sorted((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in df.collect())
    assert got == sorted(enumerate(brute(texts)))


def query(spark, texts, tmp_path, extra=()):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", *extra)
    rows.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    return repeats.op11_repeats(spark, str(tmp_path))


def test_pieces_cover_every_start_once():
    rng = random.Random(1)
    for k in repeats.LEVELS:
        for text in [words(rng, 400), "a" * 600, "ab" * 500, "é" * 300, "q" * 200, "q" * 199, ""]:
            key, content, start, starts = repeats.cut(text.encode(), k)
            at = [s + i for s, n in zip(start.tolist(), starts.tolist()) for i in range(n)]
            assert at == list(range(max(0, len(text.encode()) - SPAN + 1)))
    whole = words(rng, 500).encode()
    keys = {}
    for shift in (0, 1, 77, 800):  # the key of a string doesn't depend on what surrounds it
        key, _, start, starts = repeats.cut(whole[shift : shift + 900], 32)
        for k, s, n in zip(key.tolist(), start.tolist(), starts.tolist()):
            for i in range(n):
                assert keys.setdefault(s + i + shift, k) == k


def test_segments_change_no_key(monkeypatch):
    text = words(random.Random(2), 900).encode()
    spread = lambda: {s + i: k for k, s, n in zip(*(repeats.cut(text, 32)[j].tolist() for j in (0, 2, 3))) for i in range(n)}
    whole = spread()
    monkeypatch.setattr(repeats, "SEGMENT", 301)
    assert spread() == whole


def test_index_holds_the_transform():
    """The runs spell the Burrows-Wheeler transform of sorted suffixes; matching statistics agree with all pairs."""
    rng = random.Random(3)
    base = words(rng, 80).encode()
    strings = [base[rng.randrange(200) :][: rng.randrange(250, 400)] for _ in range(6)] + [b"\0\0a" * 90, b"k" * 260]
    index = repeats.RunIndex.build(strings)
    spelled = np.repeat(index.letters, index.lengths)
    text = index.text.tolist()
    order = sorted(range(len(text)), key=lambda i: text[i : i + 500])
    assert Counter(spelled.tolist()) == Counter(text)
    agree = [text[i - 1] == s for i, s in zip(order, spelled.tolist())]
    assert sum(agree) > 0.97 * len(agree)  # suffixes that are equal to their string's end have no order of their own
    assert len(index.letters) < len(text)
    got = repeats.marked(strings, [1] * len(strings))
    every = Counter(s[i : i + SPAN] for s in strings for i in range(len(s) - SPAN + 1))
    for s, ranges in zip(strings, got):
        gone = {j for i in range(len(s) - SPAN + 1) if every[s[i : i + SPAN]] > 1 for j in range(i, i + SPAN)}
        assert {j for a, b in ranges for j in range(a, b)} == gone


@pytest.mark.parametrize("most", [repeats.MOST_PIECES, 3])
def test_against_brute_force(spark, most):
    texts = corpus(most)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (bytes(r.kept), [(x.low, x.high) for x in r.removed]) for r in repeats.without_repeats(docs, most).collect()}
    for key, (size, removed, spans, digest) in enumerate(brute(texts)):
        kept, ranges = got[key]
        assert (len(kept) + removed, sum(b - a for a, b in ranges), len(ranges), hashlib.sha256(kept).hexdigest()) == (size, removed, spans, digest)


def test_query_with_odd_columns(spark, tmp_path):
    texts = corpus(7)
    checked(query(spark, texts, tmp_path, ["1 AS t1", "'x' AS key", "doc_id AS start", "null AS ranges"]), texts)


def test_repeated_rows_and_empty_tables(spark):
    text = words(random.Random(5), 100)
    rows = [(1, text), (1, text), (None, text[:150]), (None, "other " + text[40:]), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), hashlib.sha256(r.kept).hexdigest()) for r in repeats.without_repeats(docs).collect())
    assert got == sorted((str(key), digest) for (key, _), (_, _, _, digest) in zip(rows, brute([t for _, t in rows])))
    assert repeats.without_repeats(docs.limit(0)).count() == 0


def test_query_on_the_table(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.op11_repeats(spark, data).collect()}
    assert got == dict(zip((r.doc_id for r in rows), brute([r.text for r in rows])))
