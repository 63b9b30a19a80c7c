"""Metrics against direct computations."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from lexspark.conf import Settings, within_parameter_budget
from lexspark.operators import evaluate as E
from lexspark.plans import catalog


def meteor(h, r):
    h, r = h.lower().split(), r.lower().split()
    used, pairs = {}, []
    for i, w in enumerate(h):
        at = [j for j, x in enumerate(r) if x == w]
        n = used.get(w, 0)
        if n < len(at):
            pairs.append((i, at[n]))
        used[w] = n + 1
    if not pairs:
        return 0.0
    chunks = 1 + sum((a + 1, b + 1) != c for (a, b), c in zip(pairs, pairs[1:]))
    p, q = len(pairs) / len(h), len(pairs) / len(r)
    return p * q / (0.9 * p + 0.1 * q) * (1 - 0.5 * (chunks / len(pairs)) ** 3)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_overlap_metrics(spark):
    rng = random.Random(3)
    pick = lambda: " ".join(rng.choices("a b c d e", k=rng.randint(0, 12)))
    pairs = [(i, pick(), pick()) for i in range(60)]
    rows = spark.createDataFrame(pairs, "id long, hypothesis string, reference string")
    got = {r.id: r.meteor for r in E.meteor(rows).collect()}
    rouge = {r.id: r.x for r in rows.select("id", E.rouge_l(F.col("hypothesis"), F.col("reference")).alias("x")).collect()}
    for i, h, r in pairs:
        assert got[i] == pytest.approx(meteor(h, r))
        a, b = h.split(), r.split()
        assert rouge[i] == pytest.approx(2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0)


def test_statistics(spark):
    rng = random.Random(4)
    values = [round(rng.random(), 3) for _ in range(37)] + [0.5, 0.5]
    rows = spark.createDataFrame([("g", v) for v in values] + [("one", 1.0), ("none", None)], "g string, v double")
    q = {r.g: (r.q1, r.q2, r.q3) for r in E.quartiles_exclusive(rows, ["g"], "v").collect()}
    assert q["g"] == pytest.approx(statistics.quantiles(values, n=4)) and "one" not in q
    got = {r.g: r for r in E.latency_summary(rows, ["g"], "v").collect()}
    assert got["g"].p95 == sorted(values)[round(0.95 * (len(values) - 1))] and got["g"]["median"] == round(statistics.median(values), 4)
    assert got["none"].n == 0 and got["none"].p95 is None


def test_recall(spark):
    ranked = spark.createDataFrame([(1, 1, "x"), (1, 2, "a"), (1, 3, "b"), (2, 1, "z")], "question_id long, rank long, item string")
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "q")], "question_id long, item string")
    got = {r.question_id: r for r in E.recall_at(ranked, gold, (1, 2, 3)).collect()}
    assert (got[1].first_hit_rank, got[1].recall_at_1, got[1].recall_at_2, got[1].recall_at_3) == (2, 0.0, 0.5, 1.0)
    assert got[2].first_hit_rank is None and got[2].recall_at_3 == 0.0


def test_classes(spark):
    rows = spark.createDataFrame([(None, None), (3, None), (None, 2), (3, 1), (1, 3), (2, 2)], "b int, a int")
    got = [r.v for r in rows.select(E.verdict(F.col("b"), F.col("a")).alias("v")).collect()]
    assert got == ["unchanged", "gold_dropped_from_top_k", "improved", "improved", "worsened", "unchanged"]
    flags = spark.createDataFrame([(False, False, False, False, False), (True, False, False, False, False), (True, True, True, True, False), (True, True, False, False, False)], "d boolean, b boolean, r boolean, f boolean, x boolean")
    got = [r.v for r in flags.select(E.failure_stage(*map(F.col, "dbrfx")).alias("v")).collect()]
    assert got == ["both_miss", "rrf_ranking", "reranker_ranking", "insufficient_top_k"]
    kept = spark.range(1).select(E.recommendation(F.lit(0.02), F.lit(3), F.lit(1), F.lit(10.0)).alias("v")).first().v
    assert kept == "KEEP RERANKER"


def test_confusion_and_split(spark):
    rows = spark.createDataFrame([(True, True), (False, True), (None, True)], "g boolean, p boolean")
    got = E.confusion(rows, "g", "p").first()
    assert (got.tp, got.fp, got.precision, got.false_negative_rate) == (1, 1, 0.5, 0.0)
    assert E.tail_split(spark.range(10), "id", 0.25).where("validation").count() == 2
    assert E.sample(spark.range(50), "id", 7, 1).collect() == E.sample(spark.range(50), "id", 7, 1).collect()


def test_settings():
    assert Settings.from_environment({"DENSE_TOP_N": "7", "RRF_K": ""}).dense_top_k == 7
    with pytest.raises(ValueError):
        Settings(child_target_tokens=4, child_overlap_tokens=4)
    assert not within_parameter_budget({"llm": 2_000_000_000}, frozenset({"llm"}))


def test_gold_is_looked_for_in_all_documents(spark, tmp_path):
    """25 documents hold one text and 20 are ranked; one holder of another text shares no token with it and is missed."""
    text = "one two three four five six seven eight"
    documents = [(i, f"{i} x{text}y") for i in range(25)] + [(30, "some alpha beta words"), (31, "nothing here"), (32, None)]
    spark.createDataFrame(documents, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, text), (2, "lpha bet"), (3, "nowhere to be found")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.question_id: r for r in catalog.recall_at_k(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2} and got[1].recall_at_20 == 20 / 25 and got[1].recall_at_1 == 1 / 25
    assert got[2].first_hit_rank is None and got[2].recall_at_20 == 0
    assert catalog.mrr(spark, str(tmp_path)).first().asDict() == {"mrr": 0.5, "questions": 2}


def test_holders(spark):
    """Texts of any number of words, cut anywhere, against a search in every document."""
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice(["ab", "c", "dd ", " e", " \n", " f", "g "]) for _ in range(n))
    docs = [(i, text(rng.randrange(40))) for i in range(80)] + [(900, None), (901, "")]
    parts = [docs[rng.randrange(80)][1] for _ in range(120)]
    asked = [(i, p[rng.randrange(len(p) + 1) :][: rng.randrange(1, 30)]) for i, p in enumerate(parts)] + [(800, None), (801, "x y z w nowhere at all")]
    for some in (asked, [a for a in asked if a[1] and len(a[1].split()) > 4], []):
        got = E.holders(spark.createDataFrame(some, "question_id long, text string"), spark.createDataFrame(docs, "child_id long, text string"))
        want = {(a, b) for a, x in some for b, y in docs if x is not None and y is not None and x in y}
        assert {tuple(r) for r in got.collect()} == want
