"""Audit rules on literals."""

from pyspark.sql import functions as F

from lexspark.operators import audits as A


def test_rewrites(spark):
    good = 'ok {"original_query": "a", "legal_issue": "b", "statute_query": "c", "concept_queries": ["d"], "evidence_queries": ["e"]} x'
    rows = spark.createDataFrame([(good,), ("none",), ('{"a": 1}',)], "o string").select(A.parsed_rewrite(F.col("o"), F.lit("q")).alias("r")).collect()
    assert rows[0].r.concept_queries == ["d"] and [r.r.legal_issue for r in rows[1:]] == ["failed_to_parse"] * 2 and rows[1].r.evidence_queries == ["q"]


def test_hits(spark):
    row = spark.range(1).select(
        A.hit_citation_anywhere(F.array(F.lit("5"), F.lit("6")), F.lit(None).cast("string"), F.lit("Điều 5"), F.lit("theo Điều 7")).alias("a"),
        A.hit_article_field(F.array(F.lit("5")), F.array(F.lit("1/2020/NĐ-CP")), F.lit("Nghi-dinh-1-2020-ND-CP-x"), F.lit("Điều 5")).alias("b"),
        A.hit_article_field(F.array(F.lit("5")), F.array().cast("array<string>"), F.lit("x"), F.lit("Điều 5")).alias("c"),
        A.hit_article_field_wide(F.array(F.lit("5")), F.array().cast("array<string>"), F.lit("x"), F.lit("Điều 5")).alias("d"),
        A.hit_raw_substring(F.array(F.lit("1/2020/NĐ-CP")), F.lit("Nghi-dinh-1-2020-ND-CP-x")).alias("e"),
        A.hit_in_answer(F.array().cast("array<string>"), F.lit("Điều 5")).alias("f"),
        A.neighbours(F.array(F.lit("4"), F.lit("5"), F.lit("8")), F.array(F.lit("5"))).alias("g"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f, row.g) == (["5"], True, False, True, False, None, ["4"])


def test_classes(spark):
    some, none = F.array(F.lit("1")), F.array().cast("array<string>")
    row = spark.range(1).select(
        A.generation_class(none, F.lit(True), F.lit(True), none, none, none, F.lit(9)).alias("a"),
        A.generation_class(some, F.lit(True), F.lit(False), some, none, none, F.lit(9)).alias("b"),
        A.position_class(F.lit(True), none, none, some, F.lit(4), F.lit(1)).alias("c"),
        A.lifecycle_class(F.array(A.lifecycle_reason(F.lit(False), F.lit(True), F.lit(True), F.lit(True), F.lit(3), F.lit(False))), F.lit(True)).alias("d"),
        A.citation_coverage(some, none).alias("e"),
        A.citation_coverage(none, some).alias("f"),
    ).first()
    assert (row.a, row.b, row.c.cls, row.d, row.e, row.f) == ("NO_PARSEABLE_GOLD_ARTICLE", "CONTEXT_ORDER_OR_NEIGHBOR_NOISE", "B", "D4", 0.0, None)


def test_comparisons(spark):
    a = spark.createDataFrame([(1, ["x", "y"]), (2, ["z"]), (3, ["q"])], "question_id long, ids array<string>")
    b = spark.createDataFrame([(1, ["x", "y"]), (2, ["y"])], "question_id long, ids array<string>")
    assert sorted(r.question_id for r in A.drifted(a, b).collect()) == [2, 3]
    a = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, None)], "question_id long, r double")
    b = spark.createDataFrame([(1, 0.5), (2, 0.6), (3, None)], "question_id long, r double")
    assert [r.question_id for r in A.stored_recalls_differ(a, b, ["r"]).collect()] == [2]
    gold = spark.createDataFrame([(1, "p", 10), (1, "q", 5)], "question_id long, parent_id string, tokens long")
    assert A.context_growth(gold, gold.limit(1)).first().more_chunks == 1
    assert A.hours(7200, 10, 10.0) == 2.0
