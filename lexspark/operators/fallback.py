"""A second pass for questions whose first search looks weak: policies, the search of their rewrites, and what it brings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.operators import retrieve

#: Ranks in which a named document or article is looked for.
LOOKED_AT = 5


def signals(ranked: DataFrame, asked: DataFrame, places: DataFrame) -> DataFrame:
    """(question_id, top_score, detected, matching) of reranked candidates (question_id, child_id, rank, score).

    asked: (question_id, document_name, article), what a question names, null where nothing; places: (child_id,
    document_name, article). Detected: either is named. Matching: one of the first five candidates has what is named; also
    true where nothing is. A question without candidates has the top score 0.
    """
    best = ranked.groupBy("question_id").agg(F.min_by("score", "rank").alias("top_score"))
    seen = ranked.where(F.col("rank") <= LOOKED_AT).join(places.select("child_id", F.col("document_name").alias("_document"), F.col("article").alias("_article")), "child_id")
    named = asked.select("question_id", "document_name", "article")
    fits = lambda own, theirs: F.col(own).isNull() | F.coalesce(F.col(own) == F.col(theirs), F.lit(False))
    met = seen.join(named, "question_id").where(fits("document_name", "_document") & fits("article", "_article")).select("question_id").distinct().withColumn("_met", F.lit(True))
    rows = named.join(best, "question_id", "left").join(met, "question_id", "left")
    detected = F.col("document_name").isNotNull() | F.col("article").isNotNull()
    return rows.select("question_id", F.coalesce("top_score", F.lit(0.0)).alias("top_score"), detected.alias("detected"), (~detected | F.coalesce("_met", F.lit(False))).alias("matching"))


def score_percentiles(rows: DataFrame, shares: tuple[float, ...] = (0.10, 0.25)) -> DataFrame:
    """One row p10, p25 and so on: the value at place int(n * share), from 0, of the sorted top scores, equal ones counted."""
    counts = rows.groupBy("top_score").agg(F.count("*").alias("_c"))
    total = rows.agg(F.count("*").alias("_n"))
    # over distinct scores, split by no key: what is sorted here are counts
    upto = counts.withColumn("_to", F.sum("_c").over(Window.orderBy("top_score").rowsBetween(Window.unboundedPreceding, 0))).join(F.broadcast(total))
    return upto.agg(*[F.min(F.when(F.col("_to") > F.floor(F.col("_n") * F.lit(s)), F.col("top_score"))).alias(f"p{round(100 * s)}") for s in shares])


def policies(least: float = -0.5) -> dict[str, Column]:
    """When a question gets a second pass, by its signals and the percentiles p10 and p25 of all top scores."""
    unmatched = F.col("detected") & ~F.col("matching")
    return {"F1": unmatched, "F2": F.col("top_score") < least, "F3": F.col("top_score") < F.col("p25"), "F4": unmatched | (F.col("top_score") < F.col("p10"))}


def triggered(rows: DataFrame, chosen: dict[str, Column]) -> DataFrame:
    """(policy, question_id) of the questions (as signals gives them) that each policy sends to a second pass."""
    told = rows.join(F.broadcast(score_percentiles(rows)))  # one row
    return told.select("question_id", F.explode(F.array(*[F.when(c, F.lit(name)) for name, c in chosen.items()])).alias("policy")).where("policy is not null").select("policy", "question_id")


def second_pass(baseline: DataFrame, chosen: DataFrame, rewrites: DataFrame, questions: DataFrame, texts: DataFrame, k: int, scorer: retrieve.Scorer, most: int, allowed: DataFrame | None = None) -> DataFrame:
    """Candidates (policy, question_id, child_id, rank, score, added) of the questions in chosen (policy, question_id).

    Only their rewrites (question_id, list, text) are searched, each for k texts, in one pass over the texts for all
    policies; what the baseline (question_id, child_id, rank, score) lacks joins it, and both are ranked by the scorer
    against the original question. The baseline's own scores stand, so only new pairs are scored. `added` marks them.
    """
    weak = chosen.select("question_id").distinct()
    asked = rewrites.join(weak, "question_id", "left_semi").where("trim(text) <> ''").dropDuplicates(["question_id", "text"])
    keyed = asked.select(F.struct("question_id", "list").alias("question_id"), "text")
    if allowed is not None and "question_id" in allowed.columns:
        allowed = asked.select("question_id", "list").join(allowed, "question_id").select(F.struct("question_id", "list").alias("question_id"), "child_id")
    found = retrieve.bm25_top_k(keyed, texts, k, allowed).select(F.col("question_id.question_id").alias("question_id"), "child_id").distinct()
    fresh = found.join(baseline.select("question_id", "child_id"), ["question_id", "child_id"], "left_anti").withColumn("rank", F.lit(0))
    scored = retrieve.rerank(fresh, questions, texts, scorer, 1 << 30).select("question_id", "child_id", "score", F.lit(True).alias("added"))
    both = baseline.join(weak, "question_id", "left_semi").select("question_id", "child_id", "score", F.lit(False).alias("added")).unionByName(scored)
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "child_id")
    ranked = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return chosen.join(ranked, "question_id").select("policy", "question_id", "child_id", "rank", "score", "added")


def outcome(baseline: DataFrame, after: DataFrame, chosen: DataFrame, gold: DataFrame, questions: DataFrame, most: int, names: list[str]) -> DataFrame:
    """A row for each policy: questions, triggered, recall, rescued, regressed, net_gain, precision.

    A question counts as hit if one of its first `most` candidates is gold (question_id, child_id); one that a policy doesn't
    trigger keeps its baseline.
    """
    wanted = gold.select("question_id", "child_id").distinct()
    hit = lambda rows, by, name: rows.where(F.col("rank") <= most).join(wanted, ["question_id", "child_id"], "left_semi").select(*by).distinct().withColumn(name, F.lit(True))
    every = questions.select("question_id", F.explode(F.array(*map(F.lit, names))).alias("policy"))
    rows = every.join(hit(baseline, ["question_id"], "_before"), "question_id", "left").join(chosen.withColumn("_t", F.lit(True)), ["policy", "question_id"], "left")
    rows = rows.join(hit(after, ["policy", "question_id"], "_after"), ["policy", "question_id"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = rows.select("policy", yes("_t").alias("t"), yes("_before").alias("b"), F.when(yes("_t"), yes("_after")).otherwise(yes("_before")).alias("a"))
    n = lambda c: F.count(F.when(c, 1))
    t, b, a = F.col("t"), F.col("b"), F.col("a")
    out = rows.groupBy("policy").agg(F.count("*").alias("questions"), n(t).alias("triggered"), F.bround(F.avg(a.cast("int")), 4).alias("recall"), n(~b & a).alias("rescued"), n(b & ~a).alias("regressed"))
    return out.withColumn("net_gain", F.col("rescued") - F.col("regressed")).withColumn("precision", F.coalesce(F.bround(F.col("rescued") / F.nullif("triggered", F.lit(0)), 4), F.lit(0.0)))
