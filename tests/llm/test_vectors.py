"""Embedding near-dedup against brute force."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.llm import vectors

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, least):
    up, links = {i: i for i, *_ in rows}, {i: 0 for i, *_ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    good = [(i, np.array(v, np.float32).astype(float), label) for i, v, label in rows if label is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    for n, (i, v, label) in enumerate(good):
        for j, w, other in good[:n]:
            if label == other and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= least:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (links[i], root(i)) for i in up}


def rows_of(dim=32):
    rng = np.random.default_rng(2)
    out = []
    for g in range(6):
        centre = rng.normal(size=dim)
        out += [(centre + rng.normal(size=dim) * rng.choice([0.05, 0.15, 0.25]), g % 2) for _ in range(40)]
    out += [(rng.normal(size=dim), 0) for _ in range(60)]
    out += [out[0]] * 5 + [(np.zeros(dim), 1), (np.full(dim, np.nan), 1), (out[0][0], None), (out[0][0] * 3, out[0][1])]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, (v, label) in enumerate(out)]
    return rows + [(900, None, 1), (901, [], 1), (902, [None] * dim, 0), (903, rows[0][1][:5], 0)]


def test_links(spark):
    rows = rows_of()
    for block in (512, 7):
        config = vectors.CapConfig(block=block)
        got = {r.vec_id: r for r in vectors.cosine_components(spark.createDataFrame(rows, KIND).repartition(4), config).collect()}
        want = brute(rows, 0.98)
        assert len(got) == len(rows)
        found, there = sum(r.n_links for r in got.values()), sum(n for n, _ in want.values())
        assert found >= 0.9 * there and all(got[i].n_links <= n for i, (n, _) in want.items())
        for i, (n, c) in want.items():
            if got[i].n_links == n == 0:
                assert got[i].component_id == i and got[i].kept
    assert found == there and {i: r.component_id for i, r in got.items()} == {i: c for i, (_, c) in want.items()}


def test_repeated_ids_and_empty(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (0, [2.0, 0.0], 0)], KIND)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.cosine_components(rows).collect())
    assert got == [(0, 2, 0, True), (1, 2, 0, False), (1, 2, 0, False)]
    assert vectors.cosine_components(spark.createDataFrame([], KIND)).count() == 0


@pytest.mark.parametrize("dim", [2, 3, 4, 6, 8, 32, 64, 384])
@pytest.mark.parametrize("vectors_there", [500, 200_000])
def test_recall_of_the_defaults_just_above_the_threshold(dim, vectors_there):
    """Pairs planted at a cosine of 0.9802, with the caps that a label of so many vectors gets."""
    if dim * vectors_there > 2e7:
        return
    rng = np.random.default_rng(dim)
    a = rng.normal(size=(300, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    r = rng.normal(size=(300, dim))
    r -= (r * a).sum(axis=1, keepdims=True) * a
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    code = vectors.ProductCode(dim, vectors.CapConfig().fitted(vectors_there))
    pairs = zip(code.decode(a), code.decode(0.9802 * a + np.sqrt(1 - 0.9802**2) * r))
    assert np.mean([len(np.intersect1d(x, y)) > 0 for x, y in pairs]) > 0.9


def test_needed_rows_are_those_of_some_pair():
    rng = np.random.default_rng(3)
    for _ in range(200):
        lists = [np.unique(rng.integers(0, 12, rng.integers(1, 5))) for _ in range(rng.integers(2, 9))]
        side = rng.integers(0, 2, len(lists)).tolist()
        number = 6
        lists = [np.unique(np.r_[x, number]).astype(np.int64) for x in lists]
        two = min(side) != max(side)
        want = {
            i for i, x in enumerate(lists) for j, y in enumerate(lists) if i != j and (not two or side[i] != side[j]) and np.intersect1d(x, y).min() == number
        }
        assert set(vectors._needed([x.tobytes() for x in lists], side, number)) == want


def test_query_and_sql(spark, tmp_path):
    rows = rows_of()
    long = [(1000 + i, [float(np.float32(x)) for x in v], 5) for i, v in enumerate(np.random.default_rng(9).normal(size=(2, 20_000)))]
    table = spark.createDataFrame(rows + long, KIND).withColumn("n_links", F.lit("clash")).withColumn("row", F.lit(1))
    table.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in vectors.op3_embeddings(spark, str(tmp_path)).select("vec_id", "n_links", "component_id", "kept").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT vec_id, embedding, label FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    names = [d[0] for d in con.execute(vectors.SQL).description]
    want = sorted(tuple(dict(zip(names, r))[c] for c in ("vec_id", "n_links", "component_id", "kept")) for r in con.execute(vectors.SQL).fetchall())
    assert got == want
    assert {r[0]: r[1:3] for r in got if r[0] < 1000} == {i: (n, c) for i, (n, c) in brute(rows, 0.98).items()}
