"""Whole searches: candidates, fusion, reranking, expansion, context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.conf import Settings
from lexspark.operators import retrieve
from lexspark.sources.tables import small_batches, written


def hybrid_search(questions: DataFrame, children: DataFrame, settings: Settings = Settings(), allowed: DataFrame | None = None) -> DataFrame:
    """Dense and lexical candidates of all questions (question_id, text) among children (child_id, text), fused and ranked.

    Children are made once into a table, and so are their vectors, as several jobs read them.
    """
    children = small_batches(written(children.select("child_id", "text")))
    vectors = written(children.select("child_id", retrieve.hashed_embedding(F.col("text")).alias("embedding")))
    asked = questions.select("question_id", retrieve.hashed_embedding(F.col("text")).alias("embedding"))
    dense = retrieve.dense_top_k(asked, vectors, settings.dense_top_k, allowed)
    lexical = retrieve.bm25_top_k(questions, children, settings.bm25_top_k, allowed)
    return retrieve.fuse({"dense": dense, "bm25": lexical}, settings.rrf_k, settings.rrf_top_k)


def contexts(questions: DataFrame, children: DataFrame, settings: Settings = Settings(), scorer: retrieve.Scorer | None = retrieve.overlap_scorer) -> DataFrame:
    """The evidence of each question within the context budget, in rank order."""
    fused = hybrid_search(questions, children, settings)
    ranked = retrieve.rerank(fused, questions, children, scorer, settings.rerank_top_k)
    evidence = retrieve.expand(ranked, children, settings.neighbour_window, settings.parents_per_document)
    evidence = small_batches(evidence).withColumn("text", retrieve.merge_texts(F.col("texts"))).drop("texts")
    return retrieve.within_budget(evidence, settings.context_tokens, truncate_first=True)


def fallback_merge(baseline: DataFrame, rewritten: DataFrame, triggered: DataFrame) -> DataFrame:
    """Candidates (question_id, child_id, rank) of the baseline, and for triggered questions those of rewritten queries
    after them; each child once, at its first place."""
    more = rewritten.join(triggered.select("question_id").distinct(), "question_id", "left_semi")
    both = baseline.select("question_id", "child_id", F.struct(F.lit(0).alias("list"), "rank").alias("_o")).unionByName(
        more.select("question_id", "child_id", F.struct(F.lit(1).alias("list"), "rank").alias("_o"))
    )
    first = both.groupBy("question_id", "child_id").agg(F.min("_o").alias("_o"))
    return first.select("question_id", "child_id", F.row_number().over(Window.partitionBy("question_id").orderBy("_o", "child_id")).alias("rank"))
