"""Reports over runs, and answers whose provider fails."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexspark.operators import reports, retrieve
from lexspark.plans import answer

EVIDENCE = "question_id string, text string, evidence array<struct<document_id:long,document_name:string,article:string,clause:string,point:string,source_link:string,text:string>>"


def test_rollup_counts_missed_questions(spark):
    ranked = spark.createDataFrame([("a", 1, 1, "x"), ("a", 1, 2, "y"), ("b", 1, 4, "x"), ("b", 9, 1, "x")], "config string, question_id long, rank long, item string")
    gold = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "question_id long, item string")
    got = {r.config: r for r in reports.config_rollup(ranked, gold).collect()}
    assert (got["a"].questions, got["a"].recall_at_1, got["a"].recall_at_5, got["a"].mrr, got["a"].any_hit, got["a"].all_hit) == (2, 0.25, 0.5, 0.5, 0.5, 0.5)
    assert (got["b"].recall_at_3, got["b"].recall_at_5, got["b"].mrr, got["b"].all_hit) == (0.0, 0.25, 0.125, 0.0)
    gain = {(r.config, r.metric): r.gain for r in reports.gains(reports.config_rollup(ranked, gold), "a").collect()}
    assert gain["b", "recall_at_5"] == -0.25 and ("a", "mrr") not in gain


def test_gates_and_samples(spark, tmp_path):
    flags = spark.createDataFrame([(1, True, 0), (2, True, 3), (3, False, 0), (4, None, None)], "question_id long, applied boolean, matched long")
    full = lambda authoritative: [r.full_corpus for r in reports.effective_filter(flags, F.lit(authoritative)).orderBy("question_id").collect()]
    assert full(False) == [True, False, True, True] and full(True) == [False, False, True, True]
    assert reports.experiment_gate(0.45, 0.48) and not reports.experiment_gate(0.45, 0.47)
    assert [r.id for r in reports.stride_sample(spark.range(1000), "id", 97, 3).collect()] == [0, 97, 194]
    assert {r.answer for r in reports.probe_submission(flags, "same").collect()} == {"same"}
    reports.require_no_failures(flags.limit(0))
    with pytest.raises(ValueError):
        reports.require_no_failures(flags)
    reports.require_no_failures(flags, allowed=True)
    reports.write_scores(spark.createDataFrame([("q", 0.5)], "question_id string, score double"), f"{tmp_path}/scores")
    assert [tuple(r) for r in spark.read.option("header", True).csv(f"{tmp_path}/scores").collect()] == [("q", "0.5")]


def test_prompt_without_room(spark):
    rows = spark.createDataFrame([(1, 1, "a b c")], "question_id long, rank long, text string")
    assert [(r.cost, r.fits) for r in reports.prompt_fit(rows, F.col("text"), 100, 20, 43).collect()] == [(5, True)]
    assert not reports.prompt_fit(rows, F.col("text"), 100, 20, 44).first().fits
    with pytest.raises(ValueError):
        reports.prompt_fit(rows, F.col("text"), 100, 20, 48)


def test_one_failure_costs_one_answer(spark):
    def provider(question: pd.Series, evidence: pd.Series) -> pd.Series:
        if (question == "bad").any():
            raise RuntimeError("CUDA out of memory")
        return question + " [1]."

    def longer(question: pd.Series, evidence: pd.Series) -> pd.Series:
        return pd.Series(["word " * 300 + "[1]."] * len(question))

    e = [(1, "n", None, None, None, "", "good words here")]
    rows = spark.createDataFrame([("1", "good words", e), ("2", "bad", e), ("3", "other things entirely", e), ("4", "bad", [])], EVIDENCE).coalesce(1)
    got = {r.question_id: r for r in answer.generate_answers(rows, provider, longer).collect()}
    assert got["1"].grounded and got["1"].error is None and not got["1"].repaired
    assert got["2"].answer is None and "CUDA" in got["2"].error and not got["2"].repaired
    assert got["3"].repaired and len(got["3"].answer.split()) == 192 and got["4"].abstained
    log = answer.failures(answer.generate_answers(rows, provider)).collect()
    assert [(r.question_id, r.failure) for r in log] == [("2", "CUDA_OOM")]
    prompt = rows.select(answer.repair_prompt(F.col("text"), F.lit("a"), F.array(F.lit("wrong")), F.col("evidence")).alias("p")).first().p
    assert prompt == "good words\n\na\n\nwrong\n\n[1]\ndocument_name: n\ngood words here"


def test_rewrites_share_one_pass(spark):
    texts = spark.createDataFrame([(0, "a b"), (1, "b c"), (2, "c d"), (3, "x y"), (4, "z")], "child_id long, text string")
    ask = {n: spark.createDataFrame([(7, q)], "question_id long, text string") for n, q in (("one", "a"), ("two", "c"))}
    got = retrieve.bm25_lists(ask, texts, 5)
    for name, rows in ask.items():
        want = [tuple(r) for r in retrieve.bm25_top_k(rows, texts, 5).select("question_id", "child_id", "score", "rank").orderBy("rank").collect()]
        assert [tuple(r) for r in got.where(F.col("list") == name).drop("list").orderBy("rank").collect()] == want


def test_numbers_beyond_five_digits(spark, data, tmp_path):
    import duckdb

    from lexspark.plans import catalog
    from lexspark.plans import reports as plans

    con = duckdb.connect()
    for name, rows in (("orders", spark.read.parquet(f"{data}/orders.parquet").withColumn("o_custkey", F.col("o_custkey") + 99_950)), ("lineitem", spark.read.parquet(f"{data}/lineitem.parquet"))):
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = plans.filter_statistics(spark, str(tmp_path))
    assert tuple(got.first()) == con.execute(catalog.SQL["filter_statistics"]).fetchone()
