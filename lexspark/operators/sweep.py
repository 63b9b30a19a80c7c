"""Settings of a search replayed on one table of candidates."""

from __future__ import annotations

from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What a candidate without a reranker's score counts. Fixed value.
MISSING_SCORE = -999.0


@dataclass(frozen=True)
class Setting:
    name: str
    dense: int
    bm25: int
    fused: int
    reranked: int


#: The settings that are compared. Fixed values.
SETTINGS = (
    Setting("Baseline", 20, 20, 50, 20), Setting("B", 30, 30, 60, 20), Setting("C", 40, 40, 75, 20), Setting("D", 50, 50, 100, 20),
    Setting("E", 30, 30, 60, 30), Setting("F", 40, 40, 75, 30), Setting("G", 50, 50, 100, 30), Setting("H", 50, 50, 100, 40),
)


def replay(candidates: DataFrame, places: DataFrame, settings: tuple[Setting, ...] = SETTINGS, k: int = 60, per_document: int = 3, budget: int = 10_000) -> DataFrame:
    """Every setting on the same candidates: (config, question_id, parent_id, place, cost, spent, fits, best_child_id).

    candidates: (question_id, child_id, dense_rank, bm25_rank, rerank_score), nulls where a child is in one list only or has
    no score (then MISSING_SCORE); places: (child_id, parent_id, document_name, tokens: its parent's). Candidates are read
    once and meet their places once; settings are exploded over them, and what follows are windows by setting and question:
    fusion, the reranked cut, a parent's first place, `per_document` parents of a document, and a running budget, which ends
    a context at the first parent that doesn't fit.
    """
    spark = candidates.sparkSession
    named = spark.createDataFrame([astuple(s) for s in settings], "config string, _dense int, _bm25 int, _fused int, _reranked int")
    rows = candidates.join(places, "child_id").join(F.broadcast(named))  # a short list of settings
    part = lambda rank, most: F.when(F.col(rank) <= F.col(most), 1.0 / (k + F.col(rank)))
    dense, lexical = part("dense_rank", "_dense"), part("bm25_rank", "_bm25")
    rows = rows.withColumn("fusion", F.round(F.coalesce(dense, F.lit(0.0)) + F.coalesce(lexical, F.lit(0.0)), 12)).where("fusion > 0")
    by = ["config", "question_id"]
    number = lambda *order: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    rows = rows.withColumn("_n", number(F.desc("fusion"), "child_id")).where("_n <= _fused")
    rows = rows.withColumn("_score", F.coalesce("rerank_score", F.lit(MISSING_SCORE))).withColumn("_n", number(F.desc("_score"), "child_id")).where("_n <= _reranked")
    parents = rows.groupBy(*by, "parent_id", "document_name").agg(F.min("_n").alias("_first"), F.min_by("child_id", "_n").alias("best_child_id"), F.max("tokens").alias("cost"))
    of_document = F.row_number().over(Window.partitionBy(*by, "document_name").orderBy("_first"))
    parents = parents.withColumn("_d", of_document).where(F.col("_d") <= per_document)
    upto = Window.partitionBy(*by).orderBy("_first").rowsBetween(Window.unboundedPreceding, 0)
    cost = F.coalesce("cost", F.lit(0)).cast("long")
    return parents.select(
        *by, "parent_id", number("_first").cast("long").alias("place"), cost.alias("cost"), F.sum(cost).over(upto).alias("spent"), (F.sum(cost).over(upto) <= budget).alias("fits"), "best_child_id"
    )


def lost_in_fusion(candidates: DataFrame, gold: DataFrame, settings: tuple[Setting, ...] = SETTINGS, k: int = 60) -> DataFrame:
    """(config, questions, lost): of how many questions a setting's lists hold gold (question_id, child_id) but its fusion none."""
    spark = candidates.sparkSession
    named = spark.createDataFrame([astuple(s) for s in settings], "config string, _dense int, _bm25 int, _fused int, _reranked int")
    rows = candidates.join(gold.select("question_id", "child_id").distinct().withColumn("_gold", F.lit(True)), ["question_id", "child_id"], "left").join(F.broadcast(named))
    part = lambda rank, most: F.coalesce(F.when(F.col(rank) <= F.col(most), 1.0 / (k + F.col(rank))), F.lit(0.0))
    rows = rows.withColumn("fusion", F.round(part("dense_rank", "_dense") + part("bm25_rank", "_bm25"), 12)).where("fusion > 0")
    order = Window.partitionBy("config", "question_id").orderBy(F.desc("fusion"), "child_id")
    held = F.coalesce("_gold", F.lit(False))
    some = lambda c: F.max(c.cast("int"))
    each = rows.withColumn("_n", F.row_number().over(order)).groupBy("config", "question_id").agg(some(held).alias("_in"), some(held & (F.col("_n") <= F.col("_fused"))).alias("_out"))
    return each.groupBy("config").agg(F.count("*").alias("questions"), F.count(F.when((F.col("_in") == 1) & (F.col("_out") == 0), 1)).alias("lost"))
