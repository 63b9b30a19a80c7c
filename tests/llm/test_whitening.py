"""Whitening against whole numbers of Python and numpy's covariance."""

import math

import numpy as np
import pytest

from lexspark.llm import whitening


def brute(rows, components):
    """By plain sums of products: (n, per row deviation), covariance, eigenvalues, eigenvectors."""
    usable = [(k, v) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max((len(v) for _, v in usable), default=0)
    xs = [(k, tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) + (1_000_000,) * (dims - len(v))) for k, v in usable]
    fit = sorted({x for _, x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    scaled = [[n * c - s for c, s in zip(x, sums)] for x in fit]
    cov = np.array([[sum(r[i] * r[j] for r in scaled) / n**3 for j in range(dims)] for i in range(dims)])
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    out = []
    for k, x in xs:
        y = [n * c - s for c, s in zip(x, sums)]
        out.append((k, sum(c * c for c in y), [abs(t) / n / math.sqrt(s) for t, s in zip(np.array(y, float) @ v, e)]))
    return n, out, e, np.trace(cov)


def check(got, rows, components, signs=True):
    n, want, e, trace = brute(rows, components)
    by_key = {}
    for r in got:
        by_key.setdefault(r.vec_id, {})[r.component] = r
    assert len(got) == len(want) * len(e)
    for k, deviation, white in want:
        mine = by_key[k]
        assert sorted(mine) == list(range(1, len(e) + 1))
        for c, r in mine.items():
            assert (r.n, int(r.deviation)) == (n, deviation)
            assert abs(r.whitened) == pytest.approx(white[c - 1], abs=1e-6)
            assert r.explained == pytest.approx(e[c - 1] / trace, rel=1e-6)
            assert r.identity_error < 1e-8


def test_query_on_the_table(spark, data):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    df = whitening.op13_whitening(spark, data)
    assert dict(df.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    check(df.collect(), rows, 16)


def test_signs_agree_across_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 5)) * [5, 4, 3, 2, 1])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7), components=3).collect()
    check(got, rows, 3)
    white = np.zeros((200, 3))
    for r in got:
        white[r.vec_id, r.component - 1] = r.whitened
    assert np.abs(white.T @ white / 200 - np.eye(3)).max() < 1e-9  # fails if a row's sign differs from another's


def test_odd_rows(spark):
    """Null, empty, short and non-finite vectors, repeats, null keys and clashing columns."""
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, 0.2, 5.0]), (2, [0.1, 0.2, 5.0]), (2, [0.1, 0.2, 5.0]), (3, None), (4, [1.0, None, 2.0]), (5, [nan, 0.0, 1.0]), (6, [inf, 0.0, 1.0]), (7, [3.0]), (None, [-1.5, 2.25, 0.0]), (8, []), (9, [2.0, 7.0, -1.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, n int").selectExpr("*", "n AS component", "n AS key", "n AS x")
    got = whitening.whiten(df, components=2).collect()
    kept = [(k, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for k, v in rows]
    n, want, e, trace = brute(kept, 2)
    assert n == 5 and len(got) == 2 * len(want) == 14
    assert sorted((str(r.vec_id), int(r.deviation)) for r in got) == sorted((str(k), d) for k, d, _ in want for _ in range(2))
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.where("vec_id = 8")).count() == 0


def test_no_variance(spark):
    """Equal vectors, and a constant dimension: what can't be whitened is null."""
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert {(r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in whitening.whiten(same).collect()} == {(1, 1, 0, None, 0.0, 0.0), (2, 1, 0, None, 0.0, 0.0)}
    flat = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.component): r.whitened for r in whitening.whiten(flat).collect()}
    assert abs(got[1, 1]) == pytest.approx(1) and got[1, 1] == -got[2, 1] and got[1, 2] is got[2, 2] is None


def test_large_numbers_stay_exact(spark):
    """Entries whose squares pass 64 bits."""
    rows = [(i, [float(3**i * 7), float(-(2**i)), 1e300 if i == 5 else 0.5 * i]) for i in range(12)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), components=1).collect()
    cut = [(k, [min(c, whitening.LARGEST / 64) for c in v]) for k, v in rows]
    _, want, _, _ = brute(cut, 1)
    assert {r.vec_id: int(r.deviation) for r in got} == {k: d for k, d, _ in want}
