"""Evaluation: overlap metrics, retrieval metrics, statistics, classes, comparisons and gates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.sources.tables import picked, written

ALPHA, BETA, GAMMA = 0.9, 3.0, 0.5


def meteor_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")


def _occurrences(rows: DataFrame, text: str, pos: str) -> DataFrame:
    tokens = rows.select("id", F.posexplode(meteor_tokens(F.col(text))).alias(pos, "token"))
    return tokens.withColumn("nth", F.row_number().over(Window.partitionBy("id", "token").orderBy(pos)))


def meteor(pairs: DataFrame) -> DataFrame:
    """METEOR with exact matches of pairs (id, hypothesis, reference): the n-th occurrence of a word matches the n-th.

    Returns (id, matches, chunks, meteor); 0 without a match.
    """
    sizes = pairs.select("id", F.size(meteor_tokens(F.col("hypothesis"))).alias("h"), F.size(meteor_tokens(F.col("reference"))).alias("r"))
    met = _occurrences(pairs, "hypothesis", "hp").join(_occurrences(pairs, "reference", "rp"), ["id", "token", "nth"])
    order = Window.partitionBy("id").orderBy("hp")
    runs = met.withColumn("_new", ((F.col("hp") - F.lag("hp").over(order) != 1) | (F.col("rp") - F.lag("rp").over(order) != 1)).cast("int"))
    found = runs.groupBy("id").agg(F.count("*").alias("matches"), F.sum(F.coalesce("_new", F.lit(1))).alias("chunks"))
    p, r = F.col("matches") / F.col("h"), F.col("matches") / F.col("r")
    mean = p * r / (ALPHA * p + (1 - ALPHA) * r)
    score = mean * (1 - GAMMA * F.pow(F.col("chunks") / F.col("matches"), F.lit(BETA)))
    return sizes.join(found, "id", "left").select("id", F.coalesce("matches", F.lit(0)).alias("matches"), F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce(score, F.lit(0.0)).alias("meteor"))


def _lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, with the bits of one number as a row of the table."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    row, full = 0, (1 << len(a)) - 1
    for w in b:
        x = row | places.get(w, 0)
        row = x & ~(x - ((row << 1) | 1)) & full
    return row.bit_count()


def rouge_l(hypothesis: Column, reference: Column) -> Column:
    """F1 of the longest common subsequence of lower-cased words; 0 if either has none."""

    @F.pandas_udf("double")
    def score(h: pd.Series, r: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(h, r):
            a, b = (a or "").lower().split(), (b or "").lower().split()
            n = _lcs(a, b) if a and b else 0
            out.append(2 * n / (len(a) + len(b)) if n else 0.0)
        return pd.Series(out)

    return score(hypothesis, reference)


def recall_at(ranked: DataFrame, gold: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 5, 10, 20)) -> DataFrame:
    """Share of each question's gold items (question_id, item) that the first k of ranked (question_id, rank, item) hold.

    Also first_hit_rank (null without a hit). Questions without gold have no row.
    """
    wanted = gold.select("question_id", "item").distinct()
    sizes = wanted.groupBy("question_id").agg(F.count("*").alias("gold"))
    first = ranked.join(wanted, ["question_id", "item"]).groupBy("question_id", "item").agg(F.min("rank").alias("rank"))
    found = first.groupBy("question_id").agg(F.min("rank").alias("first_hit_rank"), *[F.sum((F.col("rank") <= k).cast("int")).alias(f"_{k}") for k in cutoffs])
    return sizes.join(found, "question_id", "left").select("question_id", "first_hit_rank", *[(F.coalesce(f"_{k}", F.lit(0)) / F.col("gold")).alias(f"recall_at_{k}") for k in cutoffs])


def holders(questions: DataFrame, documents: DataFrame, run: int = 5) -> DataFrame:
    """All pairs (question_id, child_id) where the text of a document (child_id, text) contains that of a question.

    Words between a text's first and last one stand whole in whatever contains it, so documents meet a question by the
    hash of its run of at most `run` words from the second on, and the texts are compared then. Only questions of one or
    two words, where there are any, are looked for in every document.
    """
    q = questions.select("question_id", F.col("text").alias("_q"))
    words = F.split("_q", r"\s+")
    inner = F.least(F.size(words) - 2, F.lit(run))
    sizes = sorted(r["n"] for r in q.where(F.col("_q").isNotNull()).select(inner.alias("n")).distinct().collect())  # run + 2 at most
    lengths = [n for n in sizes if n > 0]
    texts = documents.select("child_id", "text")
    short = q.where(inner <= 0).join(texts, F.contains("text", "_q")).select("question_id", "child_id")
    if not lengths:
        return short.distinct()
    hashed = lambda get, n: F.xxhash64(F.lit(n), *[get(i) for i in range(n)])
    wanted = [F.when(inner == n, hashed(lambda i: F.get(words, F.lit(i + 1)), n)) for n in lengths]
    asked = q.where(inner > 0).select("question_id", F.coalesce(*wanted).alias("_run"))
    places = lambda n: F.when(F.size("_w") >= n, F.sequence(F.lit(0), F.size("_w") - n)).otherwise(F.array().cast("array<int>"))

    def held(n: int) -> Column:
        return F.transform(places(n), lambda at: hashed(lambda i: F.get("_w", at + i), n))

    runs = documents.select("child_id", F.split("text", r"\s+").alias("_w")).select("child_id", F.explode(F.flatten(F.array(*map(held, lengths)))).alias("_run"))
    met = runs.join(asked, "_run").select("question_id", "child_id").distinct()
    found = picked(met, texts, "child_id").join(q, "question_id").where(F.contains("text", "_q")).select("question_id", "child_id")
    return (found.unionByName(short) if sizes[0] <= 0 else found).distinct()


def mean_reciprocal_rank(rank: Column) -> Column:
    return F.avg(F.coalesce(1.0 / rank, F.lit(0.0)))


def _ranked(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Adds the place of each value within its group, and the group's size, without gathering a group's values."""
    sizes = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("_n"))
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("_to", upto).join(sizes, by)


def at_place(rows: DataFrame, by: list[str], value: str, place: Column, name: str) -> DataFrame:
    """The value at a place (from 0, of _n values) of each group's sorted values; equal values are counted, not listed."""
    ranked = _ranked(rows, by, value).withColumn("_at", place.cast("long"))
    return ranked.where((F.col("_to") > F.col("_at")) & (F.col("_to") - F.col("_c") <= F.col("_at"))).select(*by, F.col(value).alias(name))


def latency_summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, median, 95th percentile by nearest rank, minimum and maximum of each group, rounded half-even to 4 digits."""
    p95 = at_place(rows, by, value, F.bround(0.95 * (F.col("_n") - 1), 0), "p95")
    r = lambda c: F.bround(c, 4)
    # summed as decimals, a mean doesn't depend on the order of the rows, and no last bit can turn its rounding
    mean = F.sum(F.col(value).cast("decimal(30,10)")).cast("double") / F.count(value)
    plain = rows.groupBy(*by).agg(
        F.count(value).alias("n"), r(mean).alias("mean"), r(F.expr(f"percentile({value}, 0.5)")).alias("median"), r(F.min(value)).alias("min"), r(F.max(value)).alias("max")
    )
    return plain.join(p95, by, "left").withColumn("p95", r(F.col("p95")))


def quartiles_exclusive(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Quartiles at places q * (n + 1) with interpolation; groups of fewer than two values have none."""
    out = None
    for name, q in (("q1", 1), ("q2", 2), ("q3", 3)):
        j = F.least(F.greatest(F.floor(q * (F.col("_n") + 1) / 4), F.lit(1)), F.col("_n") - 1)
        low = at_place(rows, by, value, j - 1, "_low")
        high = at_place(rows, by, value, j, "_high")
        n = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("_n"))
        delta = q * (F.col("_n") + 1) - 4 * j
        one = low.join(high, by).join(n, by).where("_n >= 2").select(*by, ((F.col("_low") * (4 - delta) + F.col("_high") * delta) / 4).alias(name))
        out = one if out is None else out.join(one, by)
    return out


def failure_stage(dense: Column, bm25: Column, rrf: Column, fused: Column, final: Column) -> Column:
    """The stage that lost a question's evidence, from whether each stage's list holds any of it."""
    return (
        F.when(final, "none")
        .when(~dense & ~bm25, "both_miss")
        .when((dense != bm25) & ~rrf, "rrf_ranking")
        .when(fused, "reranker_ranking")
        .when(~rrf & (dense | bm25), "insufficient_top_k")
        .otherwise("PENDING_MANUAL_REVIEW")
    )


POOR_METEOR, VERBOSE_RATIO = 0.30, 2.0


def failure_class(stage: Column, has_identifier: Column, gold_lost: Column, score: Column, ratio: Column) -> Column:
    """The class of a question, the earliest cause first."""
    return (
        F.when((stage == "both_miss") & has_identifier, "metadata_entity_failure")
        .when(stage == "both_miss", "both_miss")
        .when(stage == "rrf_ranking", "fusion_failure")
        .when(stage == "reranker_ranking", "reranker_failure")
        .when(gold_lost, "context_failure")
        .when(score.isNull(), "unscored")
        .when(score < POOR_METEOR, "generation_failure")
        .when(F.coalesce(ratio > VERBOSE_RATIO, F.lit(False)), "verbosity_failure")
        .otherwise("ok")
    )


def verdict(before: Column, after: Column) -> Column:
    """What a reranker did to a question's evidence, from its first rank before and after (null: not in the list)."""
    return (
        F.when(before.isNotNull() & after.isNull(), "gold_dropped_from_top_k")
        .when(F.coalesce(before.isNull() & after.isNotNull() | (after < before), F.lit(False)), "improved")
        .when(F.coalesce(after > before, F.lit(False)), "worsened")
        .otherwise("unchanged")
    )


def recommendation(gain_at_5: Column, improved: Column, worsened: Column, overhead_ms: Column) -> Column:
    """Whether to keep a reranker, from its gain in recall at 5, the questions it moved, and its cost."""
    return (
        F.when(gain_at_5.isNull(), "NEED MORE EVIDENCE")
        .when((gain_at_5 > 0.01) & (improved > worsened), "KEEP RERANKER")
        .when((gain_at_5 < -0.01) | (worsened > 2 * F.greatest(F.lit(1), improved)), "REMOVE RERANKER")
        .when((F.abs(gain_at_5) <= 0.01) & (overhead_ms > 200), "RERANKER ONLY AT LARGER CANDIDATE K")
        .otherwise("NEED MORE EVIDENCE")
    )


def compare_runs(a: DataFrame, b: DataFrame, score: str = "score", margin: float = 0.02) -> DataFrame:
    """Differences of two runs (question_id, score): one row with counts of rescued and regressed questions, the mean
    difference, and how many questions only one run has."""
    both = a.select("question_id", F.col(score).alias("_a")).join(b.select("question_id", F.col(score).alias("_b")), "question_id", "full")
    delta = F.col("_b") - F.col("_a")
    return both.agg(
        F.count(F.when(delta.isNotNull(), 1)).alias("questions"),
        F.bround(F.avg(delta), 6).alias("mean_delta"),
        F.count(F.when(delta > margin, 1)).alias("rescued"),
        F.count(F.when(delta < -margin, 1)).alias("regressed"),
        F.count(F.when(delta.isNull(), 1)).alias("unmatched"),
    )


def separation(rows: DataFrame, features: list[str], flag: str) -> DataFrame:
    """For each feature the difference of its means with and without the flag over its population deviation."""
    out = None
    for f in features:
        gap = F.avg(F.when(F.col(flag), F.col(f))) - F.avg(F.when(~F.col(flag), F.col(f)))
        spread = F.stddev_pop(f)
        one = rows.agg(F.lit(f).alias("feature"), F.when(spread > 0, gap / spread).alias("separation"))
        out = one if out is None else out.unionByName(one)
    return out


def gate_search(rows: DataFrame, features: list[str], delta: str, quantiles: tuple[float, ...], least: int, most: int) -> DataFrame:
    """Gates "feature above or below a threshold" that let `least` to `most` rows through, with the mean delta they give.

    Thresholds are the values at place int(q * n) of each feature; both directions are tried.
    """
    long = None
    for f in features:
        one = rows.select(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), F.col(delta).alias("delta"))
        long = one if long is None else long.unionByName(one)
    cuts = None
    for q in quantiles:
        one = at_place(long, ["feature"], "value", F.floor(q * F.col("_n")), "threshold").withColumn("q", F.lit(q))
        cuts = one if cuts is None else cuts.unionByName(one)
    # a handful of thresholds for each feature
    cuts = cuts.groupBy("feature").agg(F.collect_set("threshold").alias("_t"))
    met = long.join(cuts, "feature").select("feature", "value", "delta", F.explode("_t").alias("threshold"))
    sides = met.select("feature", "threshold", "delta", F.when(F.col("value") >= F.col("threshold"), "above").otherwise("below").alias("side"))
    total = rows.count()
    return sides.groupBy("feature", "threshold", "side").agg(F.count("*").alias("n"), F.sum("delta").alias("_s")).where(F.col("n").between(least, most)).select(
        "feature", "threshold", "side", "n", F.bround(F.col("_s") / max(total, 1), 6).alias("gain")
    )


def oracle_ceiling(rows: DataFrame, by: list[str], score: str, healthy: float) -> DataFrame:
    """What each group would add to the mean score if its weaker rows scored `healthy`."""
    total = rows.count()
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.bround(F.sum(F.greatest(F.lit(0.0), healthy - F.col(score))) / max(total, 1), 6).alias("ceiling"))


def confusion(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Counts and rates of a yes/no prediction; rows with a null on either side don't count, rates without a base are null."""
    g, p = F.col(gold), F.col(predicted)
    count = lambda c: F.count(F.when(c, 1))
    out = rows.agg(count(g & p).alias("tp"), count(~g & ~p).alias("tn"), count(~g & p).alias("fp"), count(g & ~p).alias("fn"))
    rate = lambda a, b: F.bround(F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0)), 6)
    every = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    return out.select(
        "*", rate("tp", "fp").alias("precision"), rate("tp", "fn").alias("recall"), rate("fp", "tn").alias("false_positive_rate"), rate("fn", "tp").alias("false_negative_rate"),
        F.bround((F.col("tp") + F.col("tn")) / F.nullif(every, F.lit(0)), 6).alias("accuracy"),
    )


def sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """A deterministic sample of n rows, by the order of a seeded hash."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def tail_split(rows: DataFrame, order: str, fraction: float, length: Column | None = None, most: int | None = None) -> DataFrame:
    """Adds `validation`: whether a row is among the last int(n * fraction) in order; rows without an order never are.

    With `length` and `most` rows that are longer are skipped first, and don't count. Rows that share the value at the border
    are all held out. The border is looked for in the one range of values that holds it, so no task sorts all rows.
    """
    if length is not None and most is not None:
        rows = rows.where(F.coalesce(length, F.lit(0)) <= most)
    known = rows.select(order).where(F.col(order).isNotNull())
    ranges = written(known.repartitionByRange(order).withColumn("_p", F.spark_partition_id()))
    sizes = ranges.groupBy("_p").agg(F.count("*").alias("_c"))
    total = ranges.agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    place = F.col("_n") - F.floor(F.col("_n") * F.lit(fraction))
    border = sizes.withColumn("_before", before).join(F.broadcast(total)).withColumn("_at", place - F.col("_before")).where((F.col("_at") >= 0) & (F.col("_at") < F.col("_c")))
    number = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1
    last = ranges.join(F.broadcast(border.select("_p", "_at")), "_p").withColumn("_i", number).where("_i = _at").agg(F.min(order).alias("_border"))
    return rows.join(F.broadcast(last)).withColumn("validation", F.coalesce(F.col(order) >= F.col("_border"), F.lit(False))).drop("_border")  # one row
