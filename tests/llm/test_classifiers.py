"""Quality and toxicity: held-out accuracy on the given labels, and edge cases."""

import pytest
from pyspark.sql import functions as F

from lexspark.llm import quality, toxicity

SMALL = quality.SubwordConfig(buckets=1 << 12, sample=60, steps=800)
HARD = [(1, None), (2, ""), (3, " \n"), (4, "x" * 100_000), (5, "word " * 30_000), (6, "ok"), (6, "ok")]


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.01"


def labels_of(spark, sf, name):
    return spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col(name).alias("label"))


def test_quality_held_out(spark, sf):
    got = quality.op4_quality(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = got.where("held_out").join(labels_of(spark, sf, "quality"), "doc_id").collect()
    assert sum(r.predicted == r.label for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_toxicity(spark):
    """Held-out labels of the largest table, by language."""
    sf = "/root/testdata/sf0.1"
    rows = toxicity.op9_toxicity(spark, sf).join(labels_of(spark, sf, "toxic"), "doc_id").where(quality.held_out())
    rows = rows.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.toxic for r in rows if r.label == 0) <= 0.01 * len(rows)
    for lang in ("en", "de", "fr", "es"):
        found = [r.toxic for r in rows if r.label == 1 and r.lang == lang]
        assert sum(found) >= 0.8 * len(found) > 0


def test_quality_finds_each_kind_of_junk(spark):
    """Held-out labels of the largest table: repeated words, symbols, capitals and tables are all rejected."""
    sf = "/root/testdata/sf0.1"
    rows = quality.op4_quality(spark, sf).where("held_out").join(labels_of(spark, sf, "quality"), "doc_id").collect()
    assert sum(r.predicted for r in rows if r.label == 0) <= 0.1 * sum(r.label == 0 for r in rows)
    assert sum(r.predicted for r in rows if r.label == 1) >= 0.98 * sum(r.label == 1 for r in rows)


def test_hard_rows(spark):
    rows = spark.createDataFrame(HARD, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("p_toxic", F.lit(1))
    model = quality.train(["good words here", "bad bad bad bad"] * 20, [1, 0] * 20, 0.5, SMALL)
    got = quality.score_quality(rows, model, "score").collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    chain = toxicity.train_chain(["you idiot", "you are kind", "worthless trash", "fine day"] * 20, [1, 0, 1, 0] * 20)
    got = toxicity.score_toxicity(rows, chain).collect()
    assert len(got) == 7 and all(0 <= r.p_toxic <= 1 for r in got)


def test_chain_feeds_earlier_categories():
    chain = toxicity.train_chain(["you idiot", "kind words", "worthless trash", "fine day"] * 40, [1, 0, 1, 0] * 40)
    assert chain.names == ["group_1", "group_2", "toxic"]
    assert [len(e) for e in chain.earlier] == [0, 1, 2] and max(map(abs, chain.earlier[2])) > 0
    p = toxicity.Scorer(chain).probabilities(["you idiot", "worthless trash", "fine day"])
    assert {tuple(x) for x in (p[:2, :2] > 0.5).tolist()} == {(True, False), (False, True)} and (p[:, 2] > 0.5).tolist() == [True, True, False]


def test_scores_do_not_depend_on_neighbours():
    model = quality.train(["good words here", "bad bad bad bad", "more good text", "junk junk"] * 10, [1, 0, 1, 0] * 10, 0.5, SMALL)
    chain = toxicity.train_chain(["you idiot", "kind words", "worthless trash", "fine day"] * 40, [1, 0, 1, 0] * 40)
    texts = ["", "good", "a b a", "bad bad", " ", "bad bad here", "x" * 5000, "idiot", "idiot " * 40 + "day", ""]
    for whole in (quality.Scorer(model).scores, toxicity.Scorer(chain).probabilities):
        assert whole(texts).tolist() == [whole([t])[0].tolist() for t in texts]


def test_conflicting_labels_and_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, None), (None, 1)], "doc_id long, quality int").repartition(3)
    texts, found, prior = quality.labelled_sample(spark, docs, labels, "quality", 5)
    assert (texts, found, prior) == (["a", ""], [0, 1], 0.5)


def test_without_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(HARD, "doc_id long, text string")
    assert quality.labelled_sample(spark, docs, empty, "quality", 5) == ([], [], 0.5)
    assert quality.score_quality(docs, quality.train([], [], 0.5, SMALL)).count() == 7
    assert toxicity.score_toxicity(docs, toxicity.train_chain([], [])).count() == 7
    assert quality.score_quality(docs.limit(0), quality.train([], [], 0.5, SMALL)).count() == 0


def test_learning_leaves_the_held_out_fold_alone(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts, _, _ = quality.labelled_sample(spark, docs, spark.read.parquet(f"{sf}/labels.parquet"), "quality", 1000)
    hidden = {r.text for r in docs.where(quality.held_out()).collect()} - {r.text for r in docs.where(~quality.held_out()).collect()}
    assert texts and not hidden & set(texts)
