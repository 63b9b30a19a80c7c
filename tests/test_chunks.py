"""Hierarchy, chunks and their links."""

from lexspark.conf import Settings
from lexspark.operators import chunks

LAW = "Chương I\nĐiều 3. Nội dung\n1. Khoản một\na) Điểm a\nb) Điểm b\n2. Khoản hai"


def store(spark, text, **settings):
    rows = spark.createDataFrame([(1, "Luật thử nghiệm", "link", text)], "document_id long, document_name string, source_link string, text string")
    parents, children = chunks.parent_child_chunks(rows, Settings(**settings))
    return parents.orderBy("position").collect(), children.orderBy("position").collect()


def test_hierarchy(spark):
    parents, children = store(spark, LAW)
    assert [p.article for p in parents] == ["Điều 3"]
    assert [(c.clause, c.point) for c in children] == [("Khoản 1", "Điểm a"), ("Khoản 1", "Điểm b"), ("Khoản 2", None)]
    assert children[0].chapter.startswith("Chương I")
    assert children[0].child_id == "doc:1:article:0:3:segment:0:child:0"


def test_links_and_embedding_text(spark):
    _, children = store(spark, "Điều 7. Tên\n1. Khoản một\n2. Khoản hai\n3. Khoản ba")
    assert [c.position for c in children] == [0, 1, 2]
    assert children[0].previous_child_id is None and children[2].next_child_id is None
    assert children[1].previous_child_id == children[0].child_id
    assert children[0].embedding_text.startswith("Luật thử nghiệm > Điều 7 > Khoản 1\n\n")


def test_long_article_and_fallback(spark):
    sizes = dict(parent_target_tokens=20, parent_max_tokens=30, child_target_tokens=8, child_overlap_tokens=2)
    parents, _ = store(spark, "Điều 1. " + " ".join(f"w{i}" for i in range(90)), **sizes)
    assert len(parents) > 1 and {p.chunking_method for p in parents} == {"article_segment"}
    parents, children = store(spark, " ".join(f"w{i}" for i in range(40)), **sizes)
    assert len(parents) == 2 and {c.chunking_method for c in children} == {"token_window"}
    assert parents[1].parent_id == "doc:1:fallback:1"


def test_order_of_articles(spark):
    text = "Chương I\nMục 1\nĐiều 1. a\nChương II\nĐiều 2. b\nChương I\nĐiều 3. c"
    parents, _ = store(spark, text)
    # chapters merge by label; within one the articles outside sections come first
    assert len(parents) == 3 and {p.article for p in parents} == {"Điều 1", "Điều 2", "Điều 3"}


def test_empty_and_null(spark):
    rows = spark.createDataFrame([(1, None), (2, "")], "document_id long, text string")
    assert chunks.legal_units(rows).count() == 0
    assert chunks.window_chunks(rows, 5, 1).count() == 0


def test_integrity(spark):
    documents = spark.createDataFrame([(1,)], "document_id long")
    parents = spark.createDataFrame([("p", 1), ("q", 2)], "parent_id string, document_id long")
    children = spark.createDataFrame([("a", "p", None, "b"), ("b", "p", "x", None), ("c", "r", None, None)], "child_id string, parent_id string, previous_child_id string, next_child_id string")
    got = {r.rule: r.violations for r in chunks.integrity(documents, parents, children).collect()}
    assert got == {"orphan_parents": 1, "orphan_children": 1, "dangling_previous": 1, "dangling_next": 0, "broken_links": 1}


def test_chunks_read_documents_once(spark):
    text = "Điều 1. A\n1. Một\n2. Hai\nĐiều 2. " + " ".join(f"w{i}" for i in range(30))
    rows = [(1, "A", "x", text), (2, None, None, "a b c d e f g h i"), (3, "C", "y", None), (4, "D", "y", " ")]
    documents = spark.createDataFrame(rows, "document_id long, document_name string, source_link string, text string")
    parents, children = chunks.parent_child_chunks(documents, Settings(parent_target_tokens=12, parent_max_tokens=20, child_target_tokens=8, child_overlap_tokens=2))
    got = children.orderBy("document_id", "position").collect()
    assert [(c.parent_id, c.chunking_method) for c in got if c.document_id == 1][:3] == [("doc:1:article:0:1:segment:0", "clause")] * 2 + [("doc:1:article:1:2:segment:0", "token_window")]
    assert [c.text for c in got if c.document_id == 2] == ["a b c d e f g h", "g h i"] and {c.document_id for c in got} == {1, 2}
    assert [p.position for p in parents.where("document_id = 1").orderBy("position").collect()] == [0, 1, 2, 3]
    for c, after in zip(got, got[1:]):
        assert c.next_child_id == (after.child_id if after.parent_id == c.parent_id else None)
    plan = children._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
