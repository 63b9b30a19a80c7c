"""Audits of a question-answering run: where evidence was lost, what it would be worth, which gates and policies pay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions.text import citations, name_key

#: Keys that a rewritten query must have. Fixed values.
REWRITE_KEYS = ("original_query", "legal_issue", "statute_query", "concept_queries", "evidence_queries")


def parsed_rewrite(output: Column, question: Column) -> Column:
    """A model's rewrite of a question, from the JSON object in its output; without one that has all keys, the question itself."""
    kind = "struct<original_query:string,legal_issue:string,statute_query:string,concept_queries:array<string>,evidence_queries:array<string>>"
    found = F.regexp_extract(output, r"(?s)(\{.*\})", 1)
    keys = F.json_object_keys(found)
    good = F.forall(F.array(*[F.lit(k) for k in REWRITE_KEYS]), lambda k: F.array_contains(keys, k))
    same = F.struct(question.alias("original_query"), F.lit("failed_to_parse").alias("legal_issue"), question.alias("statute_query"), F.array(question).alias("concept_queries"), F.array(question).alias("evidence_queries"))
    return F.when(F.coalesce(good, F.lit(False)), F.from_json(found, kind)).otherwise(same.cast(kind))


# ---- the definitions of "the article was hit", which differ on purpose ----------------------------------------------


def hit_citation_anywhere(gold: Column, name: Column, article: Column, text: Column) -> Column:
    """Gold articles that a chunk cites anywhere in its name, article field or text."""
    return F.array_intersect(gold, citations(F.concat_ws("\n", F.coalesce(name, F.lit("")), F.coalesce(article, F.lit("")), text), "articles"))


def hit_article_field(gold_articles: Column, gold_documents: Column, name: Column, article: Column) -> Column:
    """Whether a parent of a document named in gold has a gold article in its article field; true without gold articles."""
    named = F.exists(gold_documents, lambda d: F.contains(name_key(F.coalesce(name, F.lit(""))), name_key(d)))
    return (F.size(gold_articles) == 0) | (named & F.arrays_overlap(gold_articles, citations(F.coalesce(article, F.lit("")), "articles")))


def hit_article_field_wide(gold_articles: Column, gold_documents: Column, name: Column, article: Column) -> Column:
    """The same, but without gold documents any document counts."""
    return hit_article_field(gold_articles, gold_documents, name, article) | ((F.size(gold_documents) == 0) & F.arrays_overlap(gold_articles, citations(F.coalesce(article, F.lit("")), "articles")))


def hit_raw_substring(gold_documents: Column, name: Column) -> Column:
    """Whether a gold document's number stands in the stored name as it is."""
    return F.exists(gold_documents, lambda d: F.contains(F.coalesce(name, F.lit("")), d))


def hit_in_answer(gold: Column, answer: Column, empty: bool | None = None) -> Column:
    """Whether an answer cites a gold article; `empty` is the result without gold."""
    return F.when(F.size(gold) == 0, F.lit(empty).cast("boolean")).otherwise(F.arrays_overlap(gold, citations(answer, "articles")))


# ---- classes --------------------------------------------------------------------------------------------------------


def neighbours(cited: Column, gold: Column) -> Column:
    """Cited articles that are at most two away from a gold article without being one."""
    near = lambda c: F.exists(gold, lambda g: F.abs(c.cast("long") - g.cast("long")).between(1, 2))
    return F.array_distinct(F.filter(cited, near))


def generation_class(gold: Column, in_context: Column, hit: Column, near: Column, missing: Column, foreign: Column, words: Column) -> Column:
    """Why an answer failed although retrieval ran: the first rule that holds. Array columns are tested for emptiness."""
    some = lambda c: F.size(c) > 0
    return (
        F.when(~some(gold), "NO_PARSEABLE_GOLD_ARTICLE")
        .when(~in_context, "GOLD_NOT_IN_CONTEXT")
        .when(~hit & some(near), "CONTEXT_ORDER_OR_NEIGHBOR_NOISE")
        .when(~hit, "GOLD_IN_CONTEXT_BUT_WRONG")
        .when(some(missing), "GOLD_CONTEXT_INSUFFICIENT")
        .when(some(foreign), "CITATION_OR_GROUNDING_FAILURE")
        .when(words < 50, "ANSWER_TOO_SHORT")
        .otherwise("OTHER")
    )


def position_class(has_clauses: Column, foreign: Column, near: Column, cited: Column, gold_at: Column, cited_at: Column) -> Column:
    """A struct (cls, confidence): clause missing D, foreign citation F, neighbour C, nothing cited A, buried gold B, wrong choice A, else G."""
    some = lambda c: F.size(c) > 0
    pair = lambda c, p: F.struct(F.lit(c).alias("cls"), F.lit(p).alias("confidence"))
    buried = gold_at.isNotNull() & (gold_at >= 3) & F.coalesce(cited_at < gold_at, F.lit(False))
    return (
        F.when(~has_clauses, pair("D", 0.95)).when(some(foreign), pair("F", 0.90)).when(some(near), pair("C", 0.90)).when(~some(cited), pair("A", 0.85))
        .when(buried, pair("B", 0.80)).when(gold_at.isNotNull(), pair("A", 0.85)).otherwise(pair("G", 0.70))
    )


def causal_class(has_gold: Column, healthy: Column, in_pool: Column, after_rerank: Column, in_context: Column, complete: Column) -> Column:
    """The stage that is to blame: A never retrieved, B lost by the reranker, C by the context, E incomplete, D the answer."""
    return (
        F.when(~has_gold, "Other").when(healthy, "OK").when(~in_pool, "A").when(~after_rerank, "B").when(~in_context, "C").when(~complete, "E").otherwise("D")
    )


def category_ceilings(rows: DataFrame, cls: str, score: str, healthy: str = "OK") -> DataFrame:
    """For each class and for some combinations, what the mean score would gain if its questions scored the healthy mean."""
    mean = rows.where(F.col(cls) == healthy).agg(F.avg(score).alias("_m"))
    total = rows.agg(F.count("*").alias("_n"))
    parts = rows.groupBy(cls).agg(F.count("*").alias("n"))
    lost = rows.join(F.broadcast(mean)).groupBy(cls).agg(F.sum(F.greatest(F.lit(0.0), F.col("_m") - F.col(score))).alias("_g"))
    single = parts.join(lost, cls).join(F.broadcast(total))
    sets = {"D": ["D"], "C+D+E": ["C", "D", "E"], "A+B+C+D+E": ["A", "B", "C", "D", "E"]}
    named = F.array(*[F.struct(F.lit(k).alias("combination"), F.array(*map(F.lit, v)).alias("members")) for k, v in sets.items()])
    rows = single.select(cls, "n", "_g", "_n", F.explode(named).alias("c")).where(F.array_contains("c.members", F.col(cls)))
    return rows.groupBy("c.combination", "_n").agg(F.sum("n").alias("questions"), F.sum("_g").alias("_g")).select("combination", "questions", F.bround(F.col("_g") / F.col("_n"), 6).alias("ceiling"))


def lifecycle_reason(final: Column, reranked: Column, fused: Column, pool: Column, prior_parents: Column, sibling_hit: Column, cap: int = 3) -> Column:
    """Why a gold child isn't in the context."""
    return (
        F.when(final, "Not missing (In final context)")
        .when(reranked & (prior_parents >= cap), "Max parents per document limit (D4)")
        .when(reranked, "Token budget cut (D6)")
        .when(fused, "Filtered by Reranker (D7)")
        .when(pool, "Filtered by RRF fusion (D7)")
        .when(sibling_hit, "Neighbor expansion omitted (D5)")
        .otherwise("Not in candidate pool (D7)")
    )


def lifecycle_class(reasons: Column, has_points: Column) -> Column:
    """The class of a question from the reasons of its gold children (an array; empty: none were found)."""
    any_of = lambda part: F.exists(reasons, lambda r: F.contains(r, F.lit(part)))
    return (
        F.when(any_of("Not missing") & has_points, "D3").when(any_of("Not missing"), "D2").when(any_of("Token budget cut"), "D6")
        .when(any_of("Max parents"), "D4").when(any_of("Neighbor expansion"), "D5").otherwise("D7")
    )


def evidence_by_stage(stages: DataFrame, gold: DataFrame) -> DataFrame:
    """Mean recall of each stage: of articles, clauses, points, and of all of them at once.

    stages: (question_id, stage, articles, clauses, points), arrays of what the stage's texts hold; gold the same without a
    stage. Questions without any gold article don't count.
    """
    g = gold.where(F.size("articles") > 0).select("question_id", *[F.col(c).alias(f"_{c}") for c in ("articles", "clauses", "points")])
    both = stages.join(g, "question_id")
    hit = F.arrays_overlap("articles", "_articles")
    all_of = lambda c: F.size(F.array_except(f"_{c}", c)) == 0
    share = lambda c: F.bround(F.avg(c.cast("double")), 4)
    return both.groupBy("stage").agg(
        F.count("*").alias("questions"), share(hit).alias("article"), share(all_of("clauses")).alias("clauses"), share(all_of("points")).alias("points"), share(hit & all_of("clauses") & all_of("points")).alias("full")
    )


def context_growth(gold_parents: DataFrame, context: DataFrame) -> DataFrame:
    """How many chunks and tokens adding each question's missing gold parents (question_id, parent_id, tokens) would take."""
    missing = gold_parents.join(context.select("question_id", "parent_id"), ["question_id", "parent_id"], "left_anti")
    return missing.groupBy("question_id").agg(F.count("*").alias("more_chunks"), F.sum("tokens").alias("more_tokens"))


def citation_coverage(gold: Column, context: Column) -> Column:
    """Share of gold citations that the context holds; null without gold."""
    return F.size(F.array_intersect(gold, context)) / F.nullif(F.size(gold), F.lit(0))


def budget_probe(evidence: DataFrame, budgets: list[int]) -> DataFrame:
    """For each budget how many evidences and tokens questions get, and how many questions lose any.

    evidence: (question_id, rank, cost). The budgets are a short list of settings.
    """
    order = Window.partitionBy("question_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = evidence.withColumn("spent", F.sum("cost").over(order)).select("*", F.explode(F.array(*map(F.lit, budgets))).alias("budget"))
    fits = F.col("spent") <= F.col("budget")
    each = rows.groupBy("budget", "question_id").agg(F.count(F.when(fits, 1)).alias("kept"), F.coalesce(F.max(F.when(fits, F.col("spent"))), F.lit(0)).alias("tokens"), F.count("*").alias("all"))
    return each.groupBy("budget").agg(
        F.bround(F.avg("kept"), 4).alias("mean_kept"), F.expr("percentile(kept, 0.5)").alias("median_kept"), F.max("kept").alias("max_kept"),
        F.bround(F.avg("tokens"), 4).alias("mean_tokens"), F.max("tokens").alias("max_tokens"), F.count(F.when(F.col("kept") < F.col("all"), 1)).alias("truncated"),
    )


def gate_features(final: DataFrame, lists: DataFrame, k: int = 20) -> DataFrame:
    """Features of each question's first k chunks: spread over articles and documents, overlap of the lists, moved ranks.

    final: (question_id, child_id, rank, document, article); lists: (question_id, child_id, list, rank) with the lists
    dense, bm25 and rrf.
    """
    top = final.where(F.col("rank") <= k)
    counts = top.groupBy("question_id", "document", "article").agg(F.count("*").alias("_n"), F.min("rank").alias("_first"))
    spread = counts.groupBy("question_id").agg(
        F.count("*").alias("n_articles"), F.count_distinct("document").alias("n_documents"), F.max("_n").alias("max_chunks_per_article"),
        (F.min_by("_n", "_first") / F.sum("_n")).alias("top1_article_share"),
    )
    ranks = lists.groupBy("question_id", "child_id").pivot("list", ["dense", "bm25", "rrf"]).agg(F.min("rank"))
    within = lambda c: F.coalesce(F.col(c) <= k, F.lit(False))
    overlap = ranks.groupBy("question_id").agg((F.count(F.when(within("dense") & within("bm25"), 1)) / k).alias("dense_bm25_overlap"))
    moved = top.join(ranks, ["question_id", "child_id"], "left").groupBy("question_id").agg(
        (F.count(F.when(within("rrf"), 1)) / k).alias("rrf_kept"), F.coalesce(F.avg(F.abs(F.col("rrf") - F.col("rank"))), F.lit(0.0)).alias("mean_rank_displacement")
    )
    return spread.join(overlap, "question_id", "left").join(moved, "question_id", "left")


def run_features(questions: DataFrame, ranked: DataFrame, places: DataFrame, traces: DataFrame, budget: int, per_document: int = 3) -> DataFrame:
    """The other features of a gate: what a question's ranked chunks become in its context, and what its run was traced to take.

    ranked: (question_id, child_id, rank); places: (child_id, parent_id, document_id, tokens: its parent's); traces:
    (question_id, metadata_confidence, metadata_candidate_count, bm25_ms, reranker_ms). Parents stand at their first child's
    rank; `per_document` of a document stay, and those that fit into the budget before the first that doesn't are the context.
    A question without chunks or without a trace has nulls.
    """
    hits = ranked.select("question_id", "child_id", "rank").join(places, "child_id")
    parents = hits.groupBy("question_id", "parent_id", "document_id").agg(F.min("rank").alias("rank"), F.max("tokens").alias("cost"))
    place = F.row_number().over(Window.partitionBy("question_id", "document_id").orderBy("rank"))
    upto = Window.partitionBy("question_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    spent = parents.withColumn("_n", place).where(F.col("_n") <= per_document).withColumn("spent", F.sum("cost").over(upto))
    fits = F.col("spent") <= budget
    context = spent.groupBy("question_id").agg(
        F.count("*").alias("parents_after_expansion"), F.count(F.when(fits, 1)).alias("evidences_in_context"), F.coalesce(F.max(F.when(fits, F.col("spent"))), F.lit(0)).alias("token_count"), F.count(F.when(~fits, 1)).alias("dropped_by_budget")
    )
    sizes = hits.groupBy("question_id").agg(F.count("*").alias("children"))
    rows = questions.select("question_id").join(sizes, "question_id", "left").join(context, "question_id", "left").join(traces, "question_id", "left")
    return rows.select("question_id", "children", "parents_after_expansion", "evidences_in_context", "token_count", "dropped_by_budget", "metadata_confidence", "metadata_candidate_count", "bm25_ms", "reranker_ms")


def features_available(features: DataFrame, names: list[str]) -> DataFrame:
    """(feature, known, missing, for_all) of each named column: a gate may only use features that every question has."""
    counts = features.agg(F.count("*").alias("_all"), *[F.count(n).alias(n) for n in names])
    told = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("known")) for n in names])).alias("f")
    rows = counts.select("_all", told).select("f.feature", "f.known", "_all")
    return rows.select("feature", "known", (F.col("_all") - F.col("known")).alias("missing"), (F.col("known") == F.col("_all")).alias("for_all"))


def policy_results(rows: DataFrame, policies: dict[str, Column]) -> DataFrame:
    """What each fallback policy would do: how often it fires, rescues, regresses, its net gain and precision.

    rows: one per question with booleans `base_hit` and `fallback_hit`; a policy is a condition on a row.
    """
    fired = F.array(*[F.struct(F.lit(n).alias("policy"), F.coalesce(c, F.lit(False)).alias("fires")) for n, c in policies.items()])
    long = rows.select("base_hit", "fallback_hit", F.explode(fired).alias("p")).select("base_hit", "fallback_hit", "p.*")
    n = lambda c: F.count(F.when(F.col("fires") & c, 1))
    after = F.when(F.col("fires"), F.col("fallback_hit")).otherwise(F.col("base_hit"))
    rescued, lost = n(~F.col("base_hit") & F.col("fallback_hit")), n(F.col("base_hit") & ~F.col("fallback_hit"))
    return long.groupBy("policy").agg(
        n(F.lit(True)).alias("triggered"), rescued.alias("rescued"), lost.alias("regressed"), (rescued - lost).alias("net_gain"),
        F.bround(rescued / F.nullif(n(F.lit(True)), F.lit(0)), 4).alias("precision"), F.bround(F.avg(after.cast("double")), 4).alias("recall"),
    )


def drifted(a: DataFrame, b: DataFrame, ids: str = "ids") -> DataFrame:
    """Questions whose lists of ids differ between two runs, or that only one run has."""
    both = a.select("question_id", F.col(ids).alias("_a")).join(b.select("question_id", F.col(ids).alias("_b")), "question_id", "full")
    return both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select("question_id")


def stored_recalls_differ(a: DataFrame, b: DataFrame, columns: list[str], least: float = 1e-6) -> DataFrame:
    """Questions whose recomputed values differ from the stored ones by more than `least`."""
    both = a.select("question_id", *columns).join(b.select("question_id", *[F.col(c).alias(f"_{c}") for c in columns]), "question_id")
    off = F.lit(False)
    for c in columns:
        off = off | F.coalesce(F.abs(F.col(c) - F.col(f"_{c}")) > least, ~F.col(c).eqNullSafe(F.col(f"_{c}")))
    return both.where(off).select("question_id")


def hours(rows: int, sampled: int, seconds: float) -> float:
    """How long all rows take at the rate of a sample."""
    return rows / (sampled / seconds) / 3600 if sampled and seconds else 0.0
