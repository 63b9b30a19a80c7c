"""The pipeline: each stage's rows and columns, and the whole against its parts."""

import corpus_pipeline
from lexspark.llm import packing, quality, toxicity
from test_jaccard import brute


def test_stages(spark, data):
    spark.conf.set("spark.lexspark.pii.key", "a key for tests")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "toxicity", "near_copies", "pii", "packing"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = spark.createDataFrame(stage(spark, docs, data).collect(), docs.schema)
        assert docs.columns == columns
        after = {r.doc_id for r in docs.collect()}
        if name == "near_copies":
            assert after == {key for key, (_, c) in brute(before, 5, 80).items() if key == c}
        if name == "pii":
            assert after == {key for key, _ in before}
        sizes.append(len(after))
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] == sizes[4] > 0.5 * sizes[0]
    want = {(r.doc_id, r.start, r.length, r.ids_crc32) for r in packing.packing_stage(spark, docs.coalesce(1), data).collect()}
    got = corpus_pipeline.run(spark, data).collect()
    assert {(r.doc_id, r.start, r.length, r.ids_crc32) for r in got} == want


def test_labels_keep_their_documents(spark, data):
    """Clean documents stay: nearly all that are labelled good and not toxic get through the two classifiers."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:2]:
        kept = stage(spark, kept, data)
    clean = labels.where("quality = 1 and toxic = 0")
    assert kept.join(clean, "doc_id", "left_semi").count() > 0.97 * clean.count()
    assert kept.join(labels.where("toxic = 1"), "doc_id", "left_semi").count() < 0.3 * labels.where("toxic = 1").count()


ODD = [(1, None), (2, ""), (3, " \n"), (5, "x" * 60_000), (6, "word " * 20_000), (7, "Ein Satz mit Wörtern."), (7, "Ein Satz mit Wörtern."), (7, "other text of the same id"), (None, "no id")]


def test_stages_take_odd_rows(spark, data):
    """Nulls, empty and long texts, repeated and null ids, extra columns with names that stages use, and an empty table."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("s"))
    docs = docs.withColumn("n_chars", F.lit(1).cast("long")).withColumn("n_private", F.lit("clash")).withColumn("p_toxic", F.lit("clash")).withColumn("_quality", F.lit(0)).withColumn("component", F.lit(9))
    for name, stage in corpus_pipeline.STAGES[2:]:
        out = stage(spark, docs, data)
        rows = out.collect()
        if name != "packing":
            assert out.columns == docs.columns
        if name == "near_copies":  # rows of one doc_id stay together; null ids are their own component
            assert sorted(str(r.doc_id) for r in rows) == sorted(str(k) for k, _ in ODD)
        assert stage(spark, docs.limit(0), data).count() == 0
    for stage in (quality.quality_stage, toxicity.toxicity_stage):
        kept = stage(spark, docs, data)
        assert kept.columns == docs.columns and {r.p_toxic for r in kept.collect()} <= {"clash"}
    model = quality.train(["good words", "bad bad"] * 10, [1, 0] * 10, 0.5, quality.SubwordConfig(buckets=1 << 12, steps=100))
    scored = quality.score_quality(docs, model, "_quality")
    assert scored.count() == len(ODD) and set(scored.columns) == set(docs.columns)
    chain = toxicity.train_chain(["you idiot", "fine day"] * 20, [1, 0] * 20)
    assert toxicity.score_toxicity(docs, chain).count() == len(ODD)
