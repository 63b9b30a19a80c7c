"""Ranking, fusion, expansion, budget and filters on literals."""

import pytest
from pyspark.sql import functions as F

from lexspark.operators import filters, retrieve
from lexspark.plans.search import fallback_merge

RANKED = "question_id long, child_id string, rank long, score double"


def lists(spark, **rows):
    return {n: spark.createDataFrame([(1, c, i + 1, 1.0) for i, c in enumerate(r)], RANKED) for n, r in rows.items()}


@pytest.mark.parametrize("dense, bm25, order", [(["a", "b"], ["b", "c"], ["b", "a", "c"]), (["a", "a"], ["a"], ["a"]), (["z"], ["a"], ["a", "z"])])
def test_fuse(spark, dense, bm25, order):
    got = retrieve.fuse(lists(spark, dense=dense, bm25=bm25)).orderBy("rank").collect()
    assert [r.child_id for r in got] == order
    if order == ["a"]:
        assert abs(got[0].score - 2 / 61) < 1e-9
    with pytest.raises(ValueError):
        retrieve.fuse(lists(spark, dense=dense), k=0)


def texts(spark, *rows):
    return spark.createDataFrame([*enumerate(rows)], "child_id long, text string")


def test_bm25_phrases_and_repeats(spark):
    c = texts(spark, "thông tư 17 2022 tt bgtvt", "2022 17 thông tư", "Luật hành động.", "khác", "khác nữa")
    ask = lambda q: retrieve.bm25_top_k(spark.createDataFrame([(1, q)], "question_id long, text string"), c, 9).orderBy("rank").collect()
    assert [r.child_id for r in ask("17/2022")] == [0]
    assert [r.child_id for r in ask("động.")] == [2] and ask("...") == []
    assert abs(ask("luật luật")[0].score - 2 * ask("luật")[0].score) < 1e-6
    assert ask("dieu") == []
    allowed = spark.createDataFrame([(1, 1)], "question_id long, child_id long")
    q = spark.createDataFrame([(1, "thông tư")], "question_id long, text string")
    assert [r.child_id for r in retrieve.bm25_top_k(q, c, 9, allowed).collect()] == [1]


def test_dense(spark):
    v = spark.createDataFrame([(i, [float(i == j) for j in range(3)]) for i in range(3)], "child_id long, embedding array<float>")
    q = spark.createDataFrame([(7, [0.9, 0.1, 0.1])], "question_id long, embedding array<float>")
    assert [r.child_id for r in retrieve.dense_top_k(q, v, 2).orderBy("rank").collect()] == [0, 1]
    assert retrieve.dense_top_k(q, v, 0).count() == 0
    allowed = spark.createDataFrame([(7, 2)], "question_id long, child_id long")
    assert [r.child_id for r in retrieve.dense_top_k(q, v, 2, allowed).collect()] == [2]


KIDS = [("A1", "A", 1, 0, "một hai ba"), ("A2", "A", 1, 1, "ba bốn năm"), ("B1", "B", 1, 0, "khác"), ("C1", "C", 1, 0, "x"), ("D1", "D", 1, 0, "x"), ("E1", "E", 2, 0, "y")]


def test_expand_and_merge(spark):
    kids = spark.createDataFrame(KIDS, "child_id string, parent_id string, document_id long, position int, text string")
    hits = lists(spark, x=["A1", "B1", "C1", "D1", "E1", "gone"])["x"]
    got = retrieve.expand(hits, kids, 1, 3).orderBy("rank").collect()
    assert [g.parent_id for g in got] == ["A", "B", "C", "E"]  # the fourth parent of document 1 stays out
    assert got[0].child_ids == ["A1", "A2"]
    merged = retrieve.expand(hits, kids, 1, 3).select(retrieve.merge_texts(F.col("texts")).alias("t")).collect()
    assert "một hai ba\n\nbốn năm" in [m.t for m in merged]


def test_expand_meets_neighbours_by_place(spark):
    kids = [(f"A{i}", "A", 1, 2 * i, f"t{i}") for i in range(4)] + [("A9", "A", 1, 2, "twin"), ("A9", "A", 1, 2, "twin")]
    children = spark.createDataFrame(kids, "child_id string, parent_id string, document_id long, position int, text string")
    rows = retrieve.expand(lists(spark, x=["A1", "A2"])["x"], children, 2)
    assert [(r["rank"], r.anchor_child_id, r.child_ids) for r in rows.collect()] == [(1, "A1", ["A0", "A1", "A9", "A2", "A3"])]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    # no join of all children of a parent, which a range of places would cut down afterwards
    assert not [line for line in plan.splitlines() if "Join" in line and ("<=" in line or ">=" in line)]


def test_budget(spark):
    rows = spark.createDataFrame([(1, i, "a b c d") for i in range(3)], "question_id long, rank long, text string")
    assert retrieve.within_budget(rows, 8).count() == 2
    assert retrieve.within_budget(rows, 3).count() == 0
    assert [r.text for r in retrieve.within_budget(rows, 3, truncate_first=True).collect()] == ["a b c"]
    with pytest.raises(ValueError):
        retrieve.prompt_budget(100, 50, 20)


def test_rerank(spark):
    c = texts(spark, "a", "a b", "c")
    q = spark.createDataFrame([(1, "a b")], "question_id long, text string")
    hits = spark.createDataFrame([(1, 2, 1), (1, 0, 2), (1, 1, 3)], "question_id long, child_id long, rank long")
    assert [r.child_id for r in retrieve.rerank(hits, q, c, retrieve.overlap_scorer, 2).orderBy("rank").collect()] == [1, 0]
    assert [r.child_id for r in retrieve.rerank(hits, q, c, None, 2).orderBy("rank").collect()] == [2, 0]


def test_query_metadata(spark):
    ask = lambda q: spark.createDataFrame([(q,)], "q string").select(filters.query_metadata(F.col("q")).alias("m")).first().m
    m = ask("Theo Điểm A khoản 2 điều 37 Luật Doanh Nghiệp quy định")
    assert (m.article, m.clause, m.point, m.document_name, m.confidence) == ("Điều 37", "Khoản 2", "Điểm a", "Luật Doanh Nghiệp", 0.0)
    assert ask("ặđiều 7").article is None
    assert (ask("văn bản id: 12").document_id, ask("17/2022/TT-BGTVT").confidence) == (12, 1.0)


def test_filter_flags(spark):
    q = spark.createDataFrame([(1, "văn bản id 1 điều 5"), (2, "17/2022/TT-AB"), (3, "gì"), (4, "văn bản id 9")], "question_id long, q string")
    names = spark.createDataFrame([(1, "Thong-tu-17-2022-TT-AB-x"), (2, "Luat-17-2022-TT-AB-y")], "document_id long, document_name string")
    kids = spark.createDataFrame([("a", 1, "Điều 5"), ("b", 1, "Điều 6")], "child_id string, document_id long, article string")
    for c in ("clause", "point", "chapter", "section"):
        kids = kids.withColumn(c, F.lit(None).cast("string"))
    flags, allowed = filters.metadata_filter(q.select("question_id", filters.query_metadata(F.col("q")).alias("metadata")), names, kids)
    got = {r.question_id: (r.applied, r.ambiguous, r.empty_lookup) for r in flags.collect()}
    assert got == {1: (True, False, False), 2: (False, True, False), 3: (False, False, False), 4: (False, False, True)}
    assert [(r.question_id, r.child_id) for r in allowed.collect()] == [(1, "a")]


def test_fallback(spark):
    a, b = lists(spark, a=["x", "y"], b=["y", "z"]).values()
    got = fallback_merge(a, b, spark.createDataFrame([(1,)], "question_id long")).orderBy("rank").collect()
    assert [r.child_id for r in got] == ["x", "y", "z"]


def test_texts_are_picked_without_a_shuffle(spark, monkeypatch):
    from lexspark.sources import tables

    many, few = spark.range(100).selectExpr("id child_id", "string(id) text"), spark.createDataFrame([(1, 3), (2, 3), (2, 200)], "question_id long, child_id long")
    for held in (10, 1):
        monkeypatch.setattr(tables, "HELD_ROWS", held)
        got = tables.picked(few, many, "child_id")
        assert sorted((r.question_id, r.child_id, r.text) for r in got.collect()) == [(1, 3, "3"), (2, 3, "3")]
        if held == 10:
            assert "ResolvedHint" in got._jdf.queryExecution().analyzed().toString()
