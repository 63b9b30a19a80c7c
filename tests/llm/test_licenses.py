"""License scans: base counts against a plain search, edits, spans."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexspark.llm import licenses


def base(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in hits]
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


def labels(text):
    return {m["label"] for m in licenses.scan(text)[1]}


@pytest.mark.parametrize(
    "text, found",
    [
        ("Released under the MIT License.", {"mit"}),
        ("Releesed undr the MIT Licence", {"mit"}),
        ("Released under the BSD License", set()),
        ("Licensed under the Apache Licence, Version 2.0", {"apache"}),
        ("This work is licensed under the GNU Generl Public License, version 3.", {"gpl"}),
        ("Licensed under CC BY-NC 4.0.", {"cc-by-nc"}),
        ("Licensed under CC BY 4.0.", {"cc-by"}),
        ("permission is hereby granted, free of charge, to any persn obtaining a copy", {"mit"}),
        ("the license of the road", set()),
        ("", set()),
    ],
)
def test_labels(text, found):
    assert labels(text) == found


def test_spans_and_edits():
    n, found = licenses.scan("one two released under teh mit license three")
    m = next(m for m in found if not m["base"])
    assert (n, m["first_word"], m["last_word"], m["edits"] > 0) == (8, 2, 6, True)
    rng = random.Random(1)
    for _ in range(50):  # any notice with as many edits as it may carry is found
        notice = next(x for x in licenses.NOTICES if not x.key)
        chars = list(notice.words)
        for _ in range(notice.edits):
            chars[rng.randrange(1, len(chars) - 1)] = rng.choice("abcxyz")
        assert notice.label in labels("a b " + "".join(chars) + " c d")


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "MIT license, mit LICENSE"), (3, "MIT license, mit LICENSE"), (4, "x " * 60_000 + "Apache License")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("matches", F.lit(0)).withColumn("keep", F.lit("k"))
    got = licenses.license_matches(df).orderBy("doc_id").collect()
    assert [r.n_words for r in got] == [0, 0, 4, 4, 60_002] and {r.keep for r in got} == {"k"}
    assert [len([m for m in r.matches if m.base]) for r in got] == [0, 0, 2, 2, 1]
    assert licenses.license_matches(df.limit(0)).count() == 0


def test_query(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in licenses.op10_license_scan(spark, data).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1


def least_edits(notice, line):
    """The least edit distance of a notice to any part of a line (dynamic programming over all parts)."""
    row = [0] * (len(line) + 1)
    for i, x in enumerate(notice, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(line, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def test_notices_against_brute_force():
    rng = random.Random(7)
    for _ in range(150):
        notice = rng.choice(licenses.NOTICES)
        chars = list(notice.words)
        key = notice.words.find(notice.key) if notice.key else -1
        for _ in range(rng.randrange(0, notice.edits + 3)):
            at = rng.randrange(1, len(chars) - 1)
            if key < 0 or not key <= at < key + len(notice.key):
                chars[at] = rng.choice([" ", "", "q", "qz"])
        text = "one two " + "".join(chars) + " three four"
        line = " ".join(re.findall("[a-z0-9]+", text))
        found = [m for m in licenses.scan(text)[1] if not m["base"] and m["label"] == notice.label]
        for other in licenses.NOTICES:
            if least_edits(other.words, line) > other.edits:
                assert not any(m["label"] == other.label for m in licenses.scan(text, (other,), {})[1])
        if least_edits(notice.words, line) == 0:
            assert found


def test_keys_may_carry_few_edits():
    assert labels("Released under the MLT license") == {"mit"} and labels("released under the bsd license") == set()
    assert labels("licensed under the gnv general public license") == {"gpl"}
    assert labels("licensed under cc by nd 4.0") == set()


def test_own_phrases_and_no_notices():
    assert licenses.scan("foo bar baz", (), {"foo bar": "x"}) == (3, [{"label": "x", "first_word": 0, "last_word": 1, "edits": 0, "base": True}])


def test_many_notices_take_linear_time():
    import time

    times = []
    for n in (500, 4000):
        began = time.process_time()
        assert len(licenses.scan("released under the mit license " * n)[1]) == 2 * n
        times.append(time.process_time() - began)
    assert times[1] < 20 * times[0]


def test_bit_masks_agree_with_the_distance_table():
    rng = random.Random(4)
    for _ in range(500):
        pattern, text = "".join(rng.choices("abc ", k=rng.randrange(1, 12))), "".join(rng.choices("abc ", k=rng.randrange(20)))
        least = min(licenses.distance(pattern, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
        for edits in range(6):
            assert licenses.within(pattern, text, edits) == (least <= edits)


def test_seeds_that_lead_nowhere_take_linear_time(monkeypatch):
    import time

    near = "permission is hereby granted free of " * 4000
    began = time.process_time()
    words, found = licenses.scan(near)
    took = time.process_time() - began
    assert words == 24_000 and not found and took < 10 * len(near) / 1e6 + 1
    mixed = near[:3000] + "permission is hereby granted free of charge to any persn obtaining a copy " + near[:3000]
    fast = licenses.scan(mixed)
    monkeypatch.setattr(licenses, "within", lambda *a: True)
    assert licenses.scan(mixed) == fast and [m["label"] for m in fast[1]] == ["mit"]
