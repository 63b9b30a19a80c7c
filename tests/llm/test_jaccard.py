"""The Jaccard join against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.llm import jaccard
from lexspark.llm.shingles import shingle_sets

KIND = "doc_id long, text string"


def sets_of(rows, k):
    out = {}
    for key, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        out[key] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())
    return out


def brute(rows, k, percent):
    sets, owners = sets_of(rows, k), defaultdict(list)
    up = {key: key for key in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for key, have in sets.items():
        shared = defaultdict(int)
        for s in have:
            for other in owners[s]:
                shared[other] += 1
            owners[s].append(key)
        for other, n in shared.items():
            if 100 * n >= percent * (len(have) + len(sets[other]) - n):
                a, b = root(key), root(other)
                up[max(a, b)] = min(a, b)
    return {key: (len(have), root(key)) for key, have in sets.items()}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def corpus():
    """A large group of near copies of many degrees, copies, passages that unrelated texts share, short and empty texts."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(3000)}" for _ in range(160)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [edited(rng, base, rng.randrange(0, 9)) for _ in range(150)]
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(90)) + " " + passage for _ in range(40)]
    texts += [texts[0]] * 12 + [passage] * 3 + ["One Two", "one  two\n", "one", "", " \t ", "é", "É"]
    texts += [" ".join(f"long{i % 9000}" for i in range(20_000))] * 2
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(10_001, None)]


@pytest.mark.parametrize("block, rows_in_block", [(2_000_000, 4000), (3000, 30)])
@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_components(spark, k, percent, block, rows_in_block):
    rows = corpus()
    df = spark.createDataFrame(rows, KIND).withColumn("component_id", F.lit("clash")).repartition(5)
    config = jaccard.JaccardConfig(words=k, percent=percent, sketch_bits=12, block=block, block_rows=rows_in_block)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, config).collect()}
    assert got == brute(rows, k, percent)


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None)]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, KIND)).collect())
    assert got == [("1", 2, 1), ("1", 2, 1), ("2", 2, 1), ("3", 0, 3), ("None", 2, None)]


def test_empty_table(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], KIND)).count() == 0


def test_shingles_of_blocks():
    texts = ["a b c d e", "", "x", "A B c D e " * 400, "é à"]
    for block in (1, 64, 1 << 19):
        got = [len(s) for s in shingle_sets(texts, 4, block)]
        assert got == [len(s) for s in sets_of([*enumerate(texts)], 4).values()]
    first, upper = shingle_sets(["a b c d", "A B C D"], 4)
    assert np.array_equal(first, upper)


def test_query(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.op2_jaccard(spark, data).collect()}
    assert got == brute(rows, 4, 85)
