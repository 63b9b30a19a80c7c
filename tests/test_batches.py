"""Batches of prompts, failure logs, small helpers of filters, readers and versions."""

import pytest
from pyspark.sql import functions as F

from lexspark.operators import evaluate, filters
from lexspark.plans import answer, batches
from lexspark.sources import readers
from lexspark.sources.writers import IndexVersions


def slow_provider():
    def provider(prompts):  # made here, so that workers needn't import this module
        import time

        time.sleep(0.02)
        if any("bad" in p for p in prompts):
            raise RuntimeError("out of memory")
        return [f" {len(p.split())} words " for p in prompts]

    return provider


def test_batches_keep_order_time_and_failures(spark, tmp_path):
    prompts = [("w " * n).strip() for n in (5, 90, 7, 300, 6, 80, 1, 2)] + ["a bad one", None]
    requests = spark.createDataFrame([(f"q{i}", i, p, 0) for i, p in enumerate(prompts)], "question_id string, ordinal int, prompt string, tokens int").coalesce(1)
    rows = batches.answer_batches(requests.repartition(3), slow_provider(), 4, 200, 50).orderBy("ordinal").collect()
    assert [r.question_id for r in rows] == [f"q{i}" for i in range(10)]
    assert rows[3].answer is None and rows[3].error == "PromptTooLong: prompt=300, generation=50, limit=200" and rows[3].seconds == 0
    assert rows[8].answer is None and rows[8].error == "RuntimeError: out of memory"
    assert [r.answer for r in rows if r.error is None] == ["5 words", "90 words", "7 words", "6 words", "80 words", "1 words", "2 words", "0 words"]
    by_batch = {}
    for r in rows:
        if r.batch:
            by_batch.setdefault(r.batch, []).append(r)
    assert all(len(b) == b[0].batch_rows <= 4 and len({r.seconds for r in b}) == 1 and sum(r.seconds for r in b) >= 0.02 for b in by_batch.values())
    again = spark.createDataFrame(rows)
    times = {r.batch: r for r in batches.batch_times(again).collect()}
    assert all(times[k].seconds == pytest.approx(sum(r.seconds for r in b)) and times[k].longest == max(r.tokens for r in b) for k, b in by_batch.items())
    log = f"file://{tmp_path}/failures"
    assert batches.append_failures(again, log) == 2 and batches.append_failures(again, log) == 2
    logged = spark.read.json(log).collect()
    assert len(logged) == 4 and {r.question_id for r in logged} == {"q3", "q8"} and {r.failure for r in logged if r.question_id == "q8"} == {"CUDA_OOM"}
    assert batches.answer_batches(requests.limit(0), slow_provider(), 4, 200, 50).count() == 0


def test_batches_go_by_length(spark):
    requests = spark.createDataFrame([(i, i, "w " * (i % 2 * 50 + 1)) for i in range(8)], "question_id long, ordinal long, prompt string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        rows = batches.answer_batches(requests, slow_provider(), 4, 200, 50).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert all(len({r.tokens for r in rows if r.batch == b}) == 1 for b in {r.batch for r in rows})


def test_repairs_that_are_too_long_or_empty_cost_their_answer(spark):
    import pandas as pd

    evidence = F.array(F.struct(F.lit(1).alias("document_id"), *[F.lit("").alias(c) for c in ("document_name", "source_link", "chapter", "section", "article", "clause", "point")], F.col("text").alias("text")))
    asked = spark.createDataFrame([("a", "Người nộp thuế kê khai."), ("b", "từ " * 300)], "question_id string, text string").withColumn("evidence", evidence)
    wrong = lambda q, e: pd.Series(["Không có chứng cứ nào cả ở đây 99."] * len(q))
    rows = {r.question_id: r for r in answer.generate_answers(asked, wrong, lambda q, e: pd.Series([" "] * len(q)), max_context=400).collect()}
    assert rows["a"].answer is None and rows["a"].error == "EmptyRepair: the repair has no text"
    assert rows["b"].answer is None and rows["b"].error.startswith("RepairTooLong: prompt=")
    short = answer.submission_rows(answer.generate_answers(asked, wrong, lambda q, e: pd.Series([" "] * len(q)), max_context=400))
    assert short.count() == 2


def test_submissions_refuse_missing_and_repeated_ids(spark):
    frame = lambda ids: spark.createDataFrame([(i, "yes", True) for i in ids], "question_id string, answer string, grounded boolean")
    assert answer.submission_rows(frame(["a", "b"])).count() == 2
    for ids in (["a", "a"], ["a", None]):
        with pytest.raises(Exception, match="question_id"):
            answer.submission_rows(frame(ids)).collect()


def test_tail_split_skips_long_rows(spark):
    rows = spark.createDataFrame([(i, 5 if i % 2 else 50) for i in range(100)] + [(None, 5)], "id long, n int").repartition(7)
    held = lambda df: sorted(r.id for r in df.where("validation").collect())
    assert held(evaluate.tail_split(rows, "id", 0.1)) == list(range(90, 100))
    assert held(evaluate.tail_split(rows, "id", 0.1, F.col("n"), 10)) == [91, 93, 95, 97, 99]
    assert held(evaluate.tail_split(rows, "id", 0.0)) == [] and evaluate.tail_split(rows.limit(0), "id", 0.5).count() == 0


def test_readers_filters_and_reports(spark, tmp_path):
    assert readers.reader_of("file:///x/corpus") is readers.reader_of("a/context_1.JSON") is readers.read_contexts
    with pytest.raises(readers.UnsupportedDocument):
        readers.reader_of("a/b.pdf")
    flags = spark.createDataFrame([(1, True), (2, False), (3, None)], "question_id long, applied boolean")
    matches = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "question_id long, child_id string")
    assert {r.question_id: r.should_filter for r in filters.should_filter(flags).collect()} == {1: True, 2: False, 3: False}
    assert [tuple(r) for r in filters.allowed_ids(flags, matches).collect()] == [(1, "a")]
    versions = IndexVersions(spark, f"file://{tmp_path}/index")
    assert versions.fingerprint() == {} and versions.read_report("v1") is None
    versions.report("v1", {"documents_total": 3})
    assert versions.read_report("v1") == {"documents_total": 3, "version": "v1"}
    before = versions.fingerprint()
    assert list(before) == ["v1/report.json"]
    (tmp_path / "index" / "v1" / "x.sqlite-wal").write_text("journal")
    assert versions.fingerprint() == before
    (tmp_path / "index" / "v1" / "more").write_text("more")
    assert versions.fingerprint() != before


def test_training_log_keeps_the_latest_entry(spark, tmp_path):
    import json

    def state(n, entries):
        folder = tmp_path / f"checkpoint-{n}"
        folder.mkdir()
        (folder / "trainer_state.json").write_text(json.dumps({"log_history": entries, "other": 1}, indent=2))

    state(20, [{"step": 10, "loss": 2.0, "epoch": 0.123456}, {"step": 10, "eval_loss": 1.5, "eval_runtime": 3.0}, {"step": 20, "loss": 1.0}])
    state(100, [{"step": 10, "loss": 1.9, "learning_rate": 0.1}, {"step": 10, "loss": 1.8}, {"loss": 0.5}])
    rows = {(r.step, r.split): r for r in readers.training_log(spark, f"file://{tmp_path}").collect()}
    assert rows.keys() == {(10, "train"), (10, "eval"), (20, "train"), (-1, "train")}
    assert rows[10, "train"].loss == 1.8 and rows[10, "eval"].loss == 1.5 and rows[10, "eval"].runtime_seconds == 3.0 and rows[20, "train"].epoch == 0.0
