"""Forensics of a run over tables: where gold evidence was lost, where it stood in the context, how two orders differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.operators import audits

#: Bits of the stages that a child has passed.
DENSE, BM25, FUSED, RERANKED = 1, 2, 4, 8
STAGE_BITS = {"dense": DENSE, "bm25": BM25, "rrf": FUSED, "reranker": RERANKED}
#: Names of the evidence classes; D1, D8 and D9 are kept for runs that were labelled by hand, no rule gives them. Fixed values.
EVIDENCE_CLASSES = tuple(f"D{i}" for i in range(1, 10))


def evidence_lifecycle(gold: DataFrame, stages: DataFrame, children: DataFrame, context: DataFrame, cap: int = 3) -> DataFrame:
    """The way of each gold child (question_id, child_id) through a run: (question_id, child_id, passed, final, reason).

    stages: (question_id, child_id, stage, rank), of the stages in STAGE_BITS; children: (child_id, parent_id, document_id);
    context: (question_id, parent_id). `passed` is the stages' bit mask. All stages are folded in one aggregation and meet
    gold once. How many parents of the document stood before a reranked child is a running count in rank order.
    """
    bit = F.create_map(*[x for k, v in STAGE_BITS.items() for x in (F.lit(k), F.lit(v))])[F.col("stage")]
    seen = stages.where(F.col("stage").isin(*STAGE_BITS)).groupBy("question_id", "child_id").agg(
        F.bit_or(bit).alias("passed"), F.min(F.when(F.col("stage") == "reranker", F.col("rank"))).alias("rank")
    )
    place = children.select("child_id", "parent_id", "document_id")
    ranked = seen.where("rank is not null").join(place, "child_id")
    first = F.row_number().over(Window.partitionBy("question_id", "parent_id").orderBy("rank", "child_id")) == 1
    before = Window.partitionBy("question_id", "document_id").orderBy("rank", "child_id").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("_first", first.cast("int")).withColumn("prior", F.coalesce(F.sum("_first").over(before), F.lit(0)))
    hit_parents = ranked.select("question_id", "parent_id").distinct().withColumn("sibling", F.lit(True))
    rows = gold.select("question_id", "child_id").distinct().join(place, "child_id")
    rows = rows.join(seen.select("question_id", "child_id", "passed"), ["question_id", "child_id"], "left")
    rows = rows.join(ranked.select("question_id", "child_id", "prior"), ["question_id", "child_id"], "left")
    rows = rows.join(hit_parents, ["question_id", "parent_id"], "left")
    rows = rows.join(context.select("question_id", "parent_id").distinct().withColumn("final", F.lit(True)), ["question_id", "parent_id"], "left")
    passed, no = F.coalesce("passed", F.lit(0)), F.lit(False)
    has = lambda b: passed.bitwiseAND(b) > 0
    reason = audits.lifecycle_reason(
        has(RERANKED) & F.coalesce("final", no), has(RERANKED), has(FUSED), has(DENSE) | has(BM25), F.coalesce("prior", F.lit(0)), F.coalesce("sibling", no), cap
    )
    return rows.select("question_id", "child_id", passed.cast("int").alias("passed"), F.coalesce("final", no).alias("final"), reason.alias("reason"))


def evidence_audit(questions: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """A row for each question (question_id, has_points): its class by the first reason that counts, and what happened to any
    of its gold children. A question without gold children is missed by retrieval."""
    passed = F.col("passed")
    some = lambda c: F.max(c.cast("int")).cast("boolean")
    told = lifecycle.groupBy("question_id").agg(
        F.count("*").alias("gold_children"),
        F.collect_set("reason").alias("_reasons"),  # at most as many as there are reasons
        some(passed.bitwiseAND(DENSE | BM25) > 0).alias("retrieved"),
        some((passed.bitwiseAND(FUSED) > 0) & (passed.bitwiseAND(RERANKED) == 0)).alias("lost_by_reranker"),
        some((passed.bitwiseAND(RERANKED) > 0) & ~F.col("final")).alias("lost_by_context"),
        some(F.col("final")).alias("in_context"),
        some(passed.bitwiseAND(RERANKED) > 0).alias("_reranked"),
    )
    rows = questions.select("question_id", "has_points").join(told, "question_id", "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    cls = audits.lifecycle_class(F.coalesce("_reasons", F.array().cast("array<string>")), F.col("has_points"))
    return rows.select(
        "question_id", F.coalesce("gold_children", F.lit(0)).alias("gold_children"), no("retrieved"), no("lost_by_reranker"), no("lost_by_context"), no("in_context"),
        F.when(F.coalesce("_reranked", F.lit(False)), "Context Construction").otherwise("Retrieval").alias("missing_due_to"), cls.alias("cls"),
    )


def evidence_classes(audit: DataFrame) -> DataFrame:
    """(cls, questions, percent) of all nine classes, those that don't occur with zero."""
    names = audit.sparkSession.createDataFrame([(c,) for c in EVIDENCE_CLASSES], "cls string")
    counts, total = audit.groupBy("cls").agg(F.count("*").alias("n")), audit.agg(F.count("*").alias("total"))
    rows = names.join(counts, "cls", "left").join(F.broadcast(total))  # one row
    return rows.select("cls", F.coalesce("n", F.lit(0)).alias("questions"), F.bround(100.0 * F.coalesce("n", F.lit(0)) / F.nullif("total", F.lit(0)), 4).alias("percent"))


def position_forensics(questions: DataFrame, cited: DataFrame, gold: DataFrame, context: DataFrame) -> DataFrame:
    """For each question (question_id, complete: the clauses that the reference uses are in the context) where gold and cited
    articles stand in the context, and the class that follows: (question_id, cls, confidence, gold_at, cited_at, foreign, near).

    cited and gold: (question_id, article); context: (question_id, position from 1, article). Articles are numbers as text.
    `foreign` counts cited articles that the context lacks, `near` those at most two away from a gold one without being gold.
    """
    first = context.groupBy("question_id", "article").agg(F.min("position").alias("at"))
    wanted = gold.select("question_id", "article").distinct()
    said = cited.select("question_id", "article").distinct()
    gold_at = wanted.join(first, ["question_id", "article"]).groupBy("question_id").agg(F.min("at").alias("gold_at"))
    placed = said.join(first, ["question_id", "article"], "left").join(wanted.withColumn("_gold", F.lit(True)), ["question_id", "article"], "left")
    number = lambda c: F.expr(f"try_cast({c} AS bigint)")
    # gold numbers and those up to two away, so that neighbours are an equality join
    near = wanted.select("question_id", F.explode(F.array(*[number("article") + i for i in (-2, -1, 1, 2)])).alias("_number")).where("_number is not null").distinct().withColumn("_near", F.lit(True))
    placed = placed.withColumn("_number", number("article")).join(near, ["question_id", "_number"], "left")
    count = lambda c: F.count(F.when(c, 1))
    told = placed.groupBy("question_id").agg(
        F.count("*").alias("cited"), F.min("at").alias("cited_at"), count(F.col("at").isNull()).alias("foreign"), count(F.col("_near").isNotNull() & F.col("_gold").isNull()).alias("near")
    )
    rows = questions.select("question_id", "complete").join(gold_at, "question_id", "left").join(told, "question_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    some = lambda c: F.when(zero(c) > 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    cls = audits.position_class(F.col("complete"), some("foreign"), some("near"), some("cited"), F.col("gold_at"), F.col("cited_at"))
    return rows.select("question_id", cls["cls"].alias("cls"), cls["confidence"].alias("confidence"), "gold_at", "cited_at", zero("foreign").alias("foreign"), zero("near").alias("near"))


def position_rollup(rows: DataFrame, scores: DataFrame, healthy: float) -> DataFrame:
    """Each class of position_forensics: questions, mean and median score (question_id, score), median places, and what the
    mean of all scores would gain if the class scored the healthy mean."""
    total = scores.agg(F.count("*").alias("_total"))
    both = rows.join(scores.select("question_id", "score"), "question_id")
    each = both.groupBy("cls").agg(
        F.count("*").alias("questions"), F.bround(F.avg("score"), 6).alias("mean_score"), F.expr("percentile(score, 0.5)").alias("median_score"), F.expr("percentile(gold_at, 0.5)").alias("median_gold_at"),
        F.expr("percentile(cited_at, 0.5)").alias("median_cited_at"), F.sum(F.greatest(F.lit(0.0), F.lit(healthy) - F.col("score"))).alias("_gain"),
    )
    return each.join(F.broadcast(total)).withColumn("ceiling", F.bround(F.col("_gain") / F.col("_total"), 6)).drop("_gain", "_total")  # one row


def order_check(left: DataFrame, right: DataFrame, k: int = 5) -> DataFrame:
    """How two scorings (list_id, item, score) of the same lists order them: (list_id, items, inversions, first_difference,
    same_top).

    Items go by falling score, equal ones by item. Inversions are pairs that the scorings order differently. They are
    counted bit by bit of the second place, not pair by pair: among items whose higher bits agree, an item with a zero bit
    is behind every item with a one bit that stands before it in the first order, a running count. That is a sort for each
    bit of a list's length. first_difference is the first place, from 1, whose items differ, null if there is none; same_top
    whether the first k agree. Items that one scoring lacks are left out of both.
    """
    place = F.row_number().over(Window.partitionBy("list_id").orderBy(F.desc("score"), "item")) - 1
    common = left.select("list_id", "item", F.col("score").alias("_a")).join(right.select("list_id", "item", F.col("score").alias("_b")), ["list_id", "item"])
    rows = common.select("list_id", "item", F.col("_a").alias("score"), "_b").withColumn("a", place)
    rows = rows.select("list_id", "item", F.col("_b").alias("score"), "a").withColumn("b", place).select("list_id", "a", "b")
    most = rows.agg(F.max("b")).first()[0] or 0
    bits = rows.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(max(0, most.bit_length() - 1)))))
    one = F.expr("(b >> bit) & 1")
    upto = Window.partitionBy("list_id", "bit", "_high").orderBy("a").rowsBetween(Window.unboundedPreceding, 0)
    behind = bits.withColumn("_high", F.expr("b >> (bit + 1)")).withColumn("_one", one).withColumn("_ones", F.sum("_one").over(upto))
    inversions = behind.where("_one = 0").groupBy("list_id").agg(F.sum("_ones").alias("inversions"))
    told = rows.groupBy("list_id").agg(F.count("*").alias("items"), F.min(F.when(F.col("a") != F.col("b"), F.col("a") + 1)).alias("first_difference"))
    told = told.join(inversions, "list_id", "left")
    return told.select("list_id", "items", F.coalesce("inversions", F.lit(0)).alias("inversions"), F.col("first_difference").cast("long").alias("first_difference"), F.coalesce(F.col("first_difference") > k, F.lit(True)).alias("same_top"))
