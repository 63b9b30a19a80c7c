"""Stored postings, lists and shards, and versions that keep tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.operators import ivf, retrieve
from lexspark.operators.postings import StoredPostings
from lexspark.sources.shards import VectorShards
from lexspark.sources.writers import IndexVersions


def texts(n, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(500)]
    return [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(3, 60))) + rng.choice(["", " hồ sơ", " a-b c/d"])) for i in range(n)]


def same(got, want):
    show = lambda rows: sorted((r.question_id, r["rank"], r.child_id, round(r.score, 6)) for r in rows.collect())
    assert show(got) == show(want) and show(want)


QUESTIONS = [(1, "w1 w2 w7"), (2, "a-b w3"), (3, "hồ sơ w1"), (4, "nothing-here"), (5, "w1 " * 3 + "w399"), (6, "c/d a-b ho so"), (7, "")]


def test_postings_give_the_rows_of_a_scan(spark, tmp_path, monkeypatch):
    from lexspark.operators import postings

    monkeypatch.setattr(postings, "BLOCK_DOCUMENTS", 16)
    rows = texts(600)
    children = spark.createDataFrame([*rows, (9999, None), (9998, "")], "child_id long, text string")
    asked = spark.createDataFrame(QUESTIONS, "question_id long, text string")
    store = StoredPostings(spark, f"file://{tmp_path}/index")
    assert store.top_k(asked, 5).count() == 0 and store.segments() == []
    store.add(children)
    assert store.issues() == []
    for k in (1, 7, 50):
        same(store.top_k(asked, k), retrieve.bm25_top_k(asked, children, k))
    some = children.where("child_id % 3 = 0").select("child_id")
    same(store.top_k(asked, 7, some), retrieve.bm25_top_k(asked, children, 7, some))
    each = asked.select("question_id").join(children.select("child_id")).where("(child_id + question_id) % 4 = 0")
    same(store.top_k(asked, 7, each), retrieve.bm25_top_k(asked, children, 7, each))
    assert store.top_k(asked, 0).count() == 0


def test_postings_change_segment_by_segment(spark, tmp_path, monkeypatch):
    from lexspark.operators import postings

    monkeypatch.setattr(postings, "BLOCK_DOCUMENTS", 32)
    asked = spark.createDataFrame(QUESTIONS, "question_id long, text string")
    first = spark.createDataFrame(texts(200), "child_id long, text string")
    changed = spark.createDataFrame([(i, t) for i, t in texts(260, 2) if i >= 150], "child_id long, text string")
    store = StoredPostings(spark, f"file://{tmp_path}/index")
    store.add(first)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "index").rglob("*.parquet")}
    store.add(changed)
    store.delete(spark.createDataFrame([(3,), (160,), (77777,)], "child_id long"))
    assert all(p.stat().st_mtime_ns == t for p, t in files.items())  # the first segment's files are untouched
    now = first.where("child_id < 150").unionByName(changed).where("child_id not in (3, 160)")
    same(store.top_k(asked, 9), retrieve.bm25_top_k(asked, now, 9))
    entries = store.postings().where("segment = 2").select(F.explode("entries.child_id").alias("c")).distinct()
    assert {r.c for r in entries.collect()} <= set(range(150, 260))
    store.add(spark.createDataFrame([(3, "w1 w1 back again")], "child_id long, text string"))
    now = now.unionByName(spark.createDataFrame([(3, "w1 w1 back again")], "child_id long, text string"))
    same(store.top_k(asked, 9), retrieve.bm25_top_k(asked, now, 9))
    n = store.compact()
    assert store.segments() == [n] and store.gone() is None and store.issues() == []
    same(store.top_k(asked, 9), retrieve.bm25_top_k(asked, now, 9))
    (tmp_path / "index" / "postings" / f"segment={n + 1}").mkdir()  # a write that was cut short
    same(store.top_k(asked, 9), retrieve.bm25_top_k(asked, now, 9))


def test_blocks_are_passed_over(spark, tmp_path, monkeypatch):
    """One text holds the rare words: the other blocks' bounds don't reach the k-th score."""
    from lexspark.operators import postings

    monkeypatch.setattr(postings, "BLOCK_DOCUMENTS", 8)
    rows = [(i, "common words here " * 3 + ("rare gem stone" if i in (5, 6, 7) else "")) for i in range(400)]
    store = StoredPostings(spark, f"file://{tmp_path}/index")
    store.add(spark.createDataFrame(rows, "child_id long, text string"))
    asked = spark.createDataFrame([(1, "rare gem stone common")], "question_id long, text string")
    left, choose = [], postings.blocks_left
    monkeypatch.setattr(postings, "blocks_left", lambda *a: left.append(choose(*a)) or left[-1])
    same(store.top_k(asked, 1), retrieve.bm25_top_k(asked, spark.createDataFrame(rows, "child_id long, text string"), 1))
    assert left[0].count() <= 3 < store.postings().select("block").distinct().count()  # of some 50 blocks


def test_entries_are_scored_part_by_part():
    import pyarrow as pa

    from lexspark.operators.postings import _scorer

    entries = [[(0, block, f"k{n}", [100 * block + c for c in range(n % 5, 40, 1 + n)], n + 1) for n in range(12)] for block in (0, 1, 2)]
    rows = [{"segment": s, "block": b, "key": k, "child_id": c, "length": [5 + i % 7 for i in c], "f": [1 + (i + n) % 3 for i in c]} for part in entries for s, b, k, c, n in part]
    kinds = pa.schema([("segment", pa.int32()), ("block", pa.int32()), ("key", pa.string()), ("child_id", pa.list_(pa.int64())), ("length", pa.list_(pa.int32())), ("f", pa.list_(pa.int64()))])
    batches = pa.Table.from_pylist(rows, kinds).to_batches(max_chunksize=5)
    pairs = [(q, f"k{n}", 0.5 + (q + n) % 4) for q in range(6) for n in range(q, 12, 2)]
    show = lambda **size: [b.to_pydict() for b in _scorer(pairs, 4, 9.0, **size)(iter(batches))]
    assert show(words=1) == show(words=5) == show() and len(show()[0]["score"]) == 24


def test_updated_postings_search_whole_questions(spark, data, tmp_path):
    """Words that no text holds change nothing, however many stand before the others."""
    import os

    import duckdb

    from lexspark.plans import catalog, stored

    for file in os.listdir(data):
        if file != "benchmark.parquet":
            os.symlink(f"{data}/{file}", f"{tmp_path}/{file}")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT item_id, (SELECT string_agg('zzz' || i, ' ' ORDER BY i) FROM range(70) t(i)) || ' ' || text AS text FROM '{data}/benchmark.parquet') TO '{tmp_path}/benchmark.parquet'")
    got = stored.postings_updated(spark, str(tmp_path))
    rows = sorted(map(repr, map(tuple, got.collect())))
    assert rows == sorted(map(repr, map(tuple, stored.postings_updated(spark, data).collect()))) and rows
    for file in os.listdir(tmp_path):
        if file.endswith(".parquet"):
            con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{tmp_path}/{file}'")
    want = con.execute(catalog.SQL["postings_updated"])
    assert got.columns == [c[0] for c in want.description] and rows == sorted(map(repr, want.fetchall()))


def vectors(n, seed=0, dim=16, clusters=40):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    return [(i, (centres[rng.integers(clusters)] + 0.6 * rng.normal(size=dim)).tolist()) for i in range(n)]


def test_lists_find_the_nearest(spark, tmp_path):
    rows = spark.createDataFrame(vectors(3000), "child_id long, embedding array<float>").repartition(6)
    unit = F.transform("embedding", lambda x: (x / F.sqrt(retrieve.dot(F.col("embedding"), F.col("embedding")))).cast("float"))
    rows = rows.withColumn("embedding", unit)
    asked = rows.where("child_id % 50 = 0").withColumnRenamed("child_id", "question_id")
    directions = ivf.learned_directions(rows, 32)
    assert directions.shape == (32, 16) and np.allclose(np.linalg.norm(directions, axis=1), 1)
    assert np.array_equal(directions, ivf.learned_directions(rows.repartition(3), 32))
    ivf.write_lists(rows, directions, f"file://{tmp_path}/lists")
    stored = spark.read.parquet(f"file://{tmp_path}/lists")
    assert stored.count() == 3000 and stored.select("child_id").distinct().count() == 3000
    exact = retrieve.dense_top_k(asked, rows, 10)
    assert ivf.recall(ivf.ivf_top_k(asked, stored, directions, 10, probes=8), exact).first().recall >= 0.95
    same(ivf.ivf_top_k(asked, stored, directions, 10, query_block=7, slice_rows=50), exact)
    same(ivf.ivf_top_k(asked, stored, directions, 10, apart=True), retrieve.dense_top_k(asked, rows, 10, apart=True))


def test_lists_of_odd_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0])], "child_id long, embedding array<double>")
    directions = ivf.learned_directions(rows, 5)
    assert len(directions) == 2
    found = ivf.ivf_top_k(rows.where("child_id = 1").withColumnRenamed("child_id", "question_id"), ivf.with_lists(rows, directions), directions, 5)
    assert sorted(r.child_id for r in found.collect()) == [1, 4]
    assert ivf.learned_directions(rows.where("child_id = 2"), 5).shape == (0, 0)


def test_shards_fill_up_and_resume(spark, tmp_path):
    root = f"file://{tmp_path}/shards"
    shards = VectorShards(spark, root, 16, shard_rows=100)
    rows = [(i, v) for i, v in vectors(350)]
    frame = lambda part: spark.createDataFrame(part, "child_id long, embedding array<double>")
    assert shards.count() == 0 and shards.issues().count() == 0
    assert shards.add(frame(rows[:130]))["rows"] == 130
    sizes = lambda: {r.shard: r["count"] for r in shards.vectors().groupBy("shard").count().collect()}
    assert sizes() == {0: 100, 1: 30}
    # a write that was cut short: its files are there, its mark is not
    shards.add(frame(rows[100:250]))
    (tmp_path / "shards" / "done" / "2").unlink()
    again = VectorShards(spark, root, 16, shard_rows=100)
    assert again.count() == 130 and again.issues().count() == 0
    assert again.add(frame(rows[100:260] + rows[:3]))["rows"] == 130
    assert again.add(frame(rows))["rows"] == 90 and again.add(frame(rows))["rows"] == 0
    assert sizes() == {0: 100, 1: 100, 2: 100, 3: 50} and again.issues().count() == 0
    stored = {r.child_id: r.embedding for r in again.vectors().collect()}
    assert stored.keys() == set(range(350))
    want = np.array(rows[7][1]) / np.linalg.norm(rows[7][1])
    assert np.allclose(stored[7], want, atol=1e-6)


def test_shards_tell_what_is_wrong(spark, tmp_path):
    import shutil

    shards = VectorShards(spark, f"file://{tmp_path}/shards", 2, shard_rows=4, normalise=False)
    frame = lambda part: spark.createDataFrame(part, "child_id long, embedding array<double>")
    for bad in ([(1, [1.0])], [(1, None)], [(None, [1.0, 2.0])], [(1, [1.0, None])]):
        with pytest.raises(ValueError):
            shards.add(frame(bad))
    shards.add(frame([(i, [float(i), 0.0]) for i in range(10)] + [(3, [9.0, 9.0])]))
    assert shards.issues().count() == 0 and shards.count() == 10
    shutil.rmtree(tmp_path / "shards" / "maps" / "batch=1" / "shard=1")
    found = {r.issue for r in shards.issues().collect()}
    assert found == {"maps: rows missing or too many", "a vector without a map entry"}


def test_versions_keep_tables(spark, tmp_path):
    root = tmp_path / "index"
    versions = IndexVersions(spark, f"file://{root}")
    frame = lambda n: spark.range(n).withColumnRenamed("id", "child_id")
    totals = {"documents_total": 1, "documents_valid": 1, "documents_failed": 0}
    versions.write("v1", {"children": frame(4), "vectors": frame(4), "lexical": frame(4)}, totals)
    versions.publish("v1")
    files = {p: p.stat().st_mtime_ns for p in root.rglob("*.parquet")}
    manifest = versions.stage("v2", {"lexical": frame(4).withColumn("text", F.lit("new"))})
    assert manifest["status"] == "ready" and manifest["built_on"] == "v1" and versions.current() == "v1"
    assert all(p.stat().st_mtime_ns == t for p, t in files.items()) and {p.name for p in (root / "v2").iterdir() if p.is_dir()} == {"lexical"}
    versions.publish("v2")
    assert versions.read("v2", "children").count() == 4 and versions.read("v2", "lexical").columns == ["child_id", "text"]
    third = versions.stage("v3", {"vectors": frame(4)})
    assert third["tables"] == {"children": "v1/children", "vectors": "v3/vectors", "lexical": "v2/lexical"} and versions.readiness("v3") == []
    assert versions.stage("v4", {"lexical": frame(3)})["status"] == "failed"  # the halves differ in number
    with pytest.raises(ValueError):
        versions.publish("v4")
    with pytest.raises(ValueError):
        versions.stage("v3", {"lexical": frame(4)})
    versions.publish("v1")  # rolled back: its own files are whole
    assert versions.current() == "v1" and versions.read("v1", "lexical").columns == ["child_id"] and versions.readiness("v1") == []
    (root / "v9" / "stray").mkdir(parents=True)
    assert versions.unused() == ["v9/stray"]
    import shutil

    shutil.rmtree(root / "v2" / "lexical")
    assert versions.readiness("v3") == ["lexical is missing"]
    (root / "v3" / "vectors" / "_SUCCESS").unlink()
    assert versions.readiness("v3") == ["lexical is missing", "vectors is unfinished"]


def test_texts_are_inverted_after_one_shuffle(spark):
    from lexspark.operators import postings

    lists, _ = postings.inverted(spark.createDataFrame([(1, "b a b"), (2, "a"), (3, None)], "child_id long, text string"), 1)
    assert [(r.term, r.holders, r.most, r.shortest, [(e.child_id, e.f, e.length, e.places) for e in sorted(r.entries)]) for r in lists.orderBy("term").collect()] == [
        ("a", 2, 1, 1, [(1, 1, 3, [1]), (2, 1, 1, [0])]), ("b", 1, 2, 3, [(1, 2, 3, [0, 2])])
    ]
    assert lists._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
