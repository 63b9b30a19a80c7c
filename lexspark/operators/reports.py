"""Reports over runs: roll-ups by configuration, gains, reranking diagnostics, score reports, checks before scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions.text import token_count

CUTOFFS = (1, 3, 5, 10, 20)


def config_rollup(ranked: DataFrame, gold: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """One row for each configuration of ranked lists (config, question_id, rank, item) against gold (question_id, item):
    questions with gold, mean recall at each cutoff, mean reciprocal rank, and the shares of questions of which any and all
    gold items were found. A question that a configuration has no list for counts as missed."""
    wanted = gold.select("question_id", "item").distinct()
    sizes = wanted.groupBy("question_id").agg(F.count("*").alias("_gold"))
    configs = ranked.select("config").distinct()
    first = ranked.join(wanted, ["question_id", "item"]).groupBy("config", "question_id", "item").agg(F.min("rank").alias("rank"))
    found = first.groupBy("config", "question_id").agg(
        F.min("rank").alias("_first"), F.count("*").alias("_found"), *[F.sum((F.col("rank") <= k).cast("int")).alias(f"_{k}") for k in cutoffs]
    )
    every = sizes.join(F.broadcast(configs)).join(found, ["config", "question_id"], "left")  # configurations are few by kind
    share = lambda c: F.coalesce(c, F.lit(0)) / F.col("_gold")
    mean = lambda c: F.bround(F.avg(c), 4)
    return every.groupBy("config").agg(
        F.count("*").alias("questions"),
        *[mean(share(F.col(f"_{k}"))).alias(f"recall_at_{k}") for k in cutoffs],
        mean(F.coalesce(1.0 / F.col("_first"), F.lit(0.0))).alias("mrr"),
        mean(F.when(F.col("_found") > 0, 1.0).otherwise(0.0)).alias("any_hit"),
        mean(F.when(F.col("_found") == F.col("_gold"), 1.0).otherwise(0.0)).alias("all_hit"),
    )


def gains(rollup: DataFrame, base: str) -> DataFrame:
    """(config, metric, gain): each metric of each configuration less that of the base one, null where either is missing."""
    metrics = [c for c in rollup.columns if c not in ("config", "questions")]
    long = rollup.select("config", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")).select("config", "m.*")
    start = long.where(F.col("config") == base).select("metric", F.col("value").alias("_base"))
    return long.where(F.col("config") != base).join(start, "metric", "left").select("config", "metric", F.bround(F.col("value") - F.col("_base"), 4).alias("gain"))


def rerank_diagnostics(ranked: DataFrame, gold: DataFrame, blockers: int = 3) -> DataFrame:
    """For each question of ranked (question_id, rank, item, score): the first two scores and their margin, the best gold
    item's rank and score, its gap to the first score, and the last items ranked above it (nearest last)."""
    marked = ranked.join(gold.select("question_id", "item").distinct().withColumn("_gold", F.lit(True)), ["question_id", "item"], "left")
    best = F.min(F.when(F.col("_gold"), F.col("rank"))).over(Window.partitionBy("question_id"))
    placed = marked.withColumn("gold_rank", best)
    near = (F.col("rank") < F.col("gold_rank")) & (F.col("rank") >= F.col("gold_rank") - blockers)
    out = placed.groupBy("question_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top1"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("top2"),
        F.max("gold_rank").alias("gold_rank"),
        F.max(F.when(F.col("rank") == F.col("gold_rank"), F.col("score"))).alias("gold_score"),
        F.array_sort(F.collect_list(F.when(near, F.struct("rank", F.col("item").cast("string").alias("item"))))).alias("_b"),
    )
    return out.select("question_id", "top1", "top2", (F.col("top1") - F.col("top2")).alias("margin"), "gold_rank", "gold_score", (F.col("top1") - F.col("gold_score")).alias("gap"), F.col("_b.item").alias("blockers"))


def filter_statistics(flags: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row: how many questions were filtered, ambiguous and empty, and how many identifiers they name."""
    count = lambda c: F.count(F.when(F.col(c), 1)).alias(c)
    named = metadata.agg(F.countDistinct("metadata.document_id").alias("document_ids"), F.countDistinct("metadata.document_number").alias("document_numbers"))
    return flags.agg(F.count("*").alias("questions"), count("applied"), count("ambiguous"), count("empty_lookup")).join(F.broadcast(named))  # one row each


def class_rollup(rows: DataFrame, cls: str, score: str, words: str, key: str, examples: int = 5) -> DataFrame:
    """Count, share, mean score, median length and the first example keys of each class."""
    total = rows.agg(F.count("*").alias("_total"))
    first = Window.partitionBy(cls).orderBy(key)
    some = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= examples).groupBy(cls).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key))), lambda x: x[key].cast("string")), ",").alias("examples"))
    plain = rows.groupBy(cls).agg(F.count("*").alias("n"), F.bround(F.avg(score), 6).alias("mean_score"), F.expr(f"percentile({words}, 0.5)").alias("median_words"))
    shares = plain.join(F.broadcast(total)).withColumn("percent", F.bround(100.0 * F.col("n") / F.col("_total"), 4)).drop("_total")  # one row
    return shares.join(some, cls)


def score_report(scores: DataFrame, worst: int = 10) -> DataFrame:
    """(place, question_id, score, words, mean_score, median_words): the worst questions of a run (question_id, score, words)
    and, in each row, the run's mean score and median length."""
    whole = scores.agg(F.bround(F.avg("score"), 6).alias("mean_score"), F.expr("percentile(words, 0.5)").alias("median_words"))
    last = scores.orderBy("score", "question_id").limit(worst)
    place = F.row_number().over(Window.orderBy("score", "question_id"))  # over the few rows of the report
    return last.withColumn("place", place.cast("long")).join(F.broadcast(whole))


def prompt_fit(evidence: DataFrame, block: Column, max_context: int, reserved: int, fixed: int, slack: int = 32) -> DataFrame:
    """Adds to evidence (question_id, rank) what its rendered block costs (its tokens and 2 more), what the prompt has spent
    up to it, and whether it still fits into what the prompt leaves for evidence. Nothing is cut short."""
    available = max_context - reserved - fixed - slack
    if available <= 0:
        raise ValueError("the prompt leaves no room for evidence")
    rows = evidence.withColumn("cost", token_count(block) + 2)
    upto = Window.partitionBy("question_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("spent", F.sum("cost").over(upto)).withColumn("fits", F.col("spent") <= available)


def vector_checks(vectors: DataFrame, dim: int, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row of counts before vectors are added to an index: all, missing ones, those of another dimension, ids that repeat."""
    repeated = vectors.groupBy(key).count().agg(F.count(F.when(F.col("count") > 1, 1)).alias("repeated_ids"))
    plain = vectors.agg(
        F.count("*").alias("vectors"), F.count(F.when(F.col(embedding).isNull(), 1)).alias("missing"), F.count(F.when(F.size(embedding) != dim, 1)).alias("other_dimension")
    )
    return plain.join(F.broadcast(repeated))  # one row each


def article_hits(answers: DataFrame) -> DataFrame:
    """Adds hit to (said, gold: arrays of cited articles): whether they share one, or both are empty."""
    return answers.withColumn("hit", F.arrays_overlap("said", "gold") | ((F.size("said") == 0) & (F.size("gold") == 0)))


def experiment_gate(base: float, other: float, least_gain: float = 0.028) -> bool:
    """Whether another run's mean score is better by at least a standard error."""
    return other - base >= least_gain


def effective_filter(flags: DataFrame, authoritative: Column) -> DataFrame:
    """Adds full_corpus to a filter's flags: whether a question is searched in all texts, as it has no filter, or one that
    nothing passes and that isn't authoritative."""
    empty = F.coalesce(F.col("applied"), F.lit(False)) & (F.coalesce(F.col("matched"), F.lit(0)) == 0)
    return flags.withColumn("full_corpus", ~F.coalesce(F.col("applied"), F.lit(False)) | (empty & ~authoritative))


def stride_sample(rows: DataFrame, row_id: str, stride: int, most: int) -> DataFrame:
    """A sampling operator: every stride-th row by a stable id, the first `most` of them."""
    return rows.where(F.pmod(F.col(row_id), F.lit(stride)) == 0).orderBy(row_id).limit(most)


def probe_submission(questions: DataFrame, sentence: str) -> DataFrame:
    """(question_id, answer): the same sentence for all questions."""
    return questions.select("question_id", F.lit(sentence).alias("answer"))


def require_no_failures(failures: DataFrame, allowed: bool = False) -> None:
    """Refuses a run to be scored that has logged failures, unless that is allowed."""
    if not allowed and not failures.isEmpty():
        raise ValueError("the run has failures; pass allowed=True to score it all the same")


def write_scores(scores: DataFrame, path: str) -> None:
    """A score table as CSV with a header, one row for each question."""
    scores.write.mode("overwrite").option("header", True).csv(path)
