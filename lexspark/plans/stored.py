"""Queries of stored indexes on the given tables: postings, lists, shards and staged versions, with SQL where it applies."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.operators import ivf, retrieve
from lexspark.operators.postings import StoredPostings
from lexspark.plans.catalog import _CHUNKS, _DENSE, _SHOW, _bm25, _near, _score, _vectors, children, doc_chunks, docs, good_documents, query, questions, ranked, searched, table
from lexspark.sources.shards import VectorShards
from lexspark.sources.tables import new_folder, written
from lexspark.sources.writers import IndexVersions


@query(f"WITH {_bm25('b', 20)} SELECT {_SHOW} FROM b")
def postings_topk(spark, d):
    """bm25_topk from stored postings."""
    store = StoredPostings(spark, new_folder(spark))
    store.add(children(spark, d))
    return ranked(store.top_k(searched(questions(spark, d)), 20), _score())


_LEFT = _bm25("b", 20, where="WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)").replace("FROM documents)", "FROM documents WHERE source IS DISTINCT FROM 'src0')").replace("[1:64]", "")


@query(f"WITH {_LEFT} SELECT {_SHOW} FROM b")
def postings_updated(spark, d):
    """Postings of all documents, French ones with half their words at first, which then come whole; those of one source are
    deleted; good documents alone are found. Questions are searched whole."""
    store = StoredPostings(spark, new_folder(spark))
    texts = docs(spark, d).select(F.col("doc_id").alias("child_id"), "text", "lang", "source")
    store.add(texts.withColumn("text", F.when(F.col("lang") == "fr", F.substr("text", F.lit(1), (F.length("text") / 2).cast("int"))).otherwise(F.col("text"))).select("child_id", "text"))
    store.add(texts.where("lang = 'fr'").select("child_id", "text"))
    store.delete(texts.where("source = 'src0'").select("child_id"))
    return ranked(store.top_k(questions(spark, d), 20, good_documents(spark, d)), _score())


@query("WITH " + _DENSE.format(same=""))
def lists_topk(spark, d):
    """dense_topk from vectors in stored lists by learned directions, all lists probed, which is exact."""
    asked, every = _vectors(spark, d)
    directions, path = ivf.learned_directions(every, 32), new_folder(spark)
    ivf.write_lists(every.select("child_id", "embedding"), directions, path)
    return _near(ivf.ivf_top_k(asked, spark.read.parquet(path), directions, 20, apart=True))


@query()
def lists_recall(spark, d):
    """How many of the ten nearest vectors a search of half the lists finds."""
    asked, every = _vectors(spark, d)
    directions = ivf.learned_directions(every, 32)
    found = ivf.ivf_top_k(asked, ivf.with_lists(every.select("child_id", "embedding"), directions), directions, 10, probes=16)
    return ivf.recall(found, retrieve.dense_top_k(asked, every.drop("label"), 10))


@query("""WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT i AS shard, least(300, n - i * 300) AS rows, 0::BIGINT AS issues, 1.0::DOUBLE AS longest FROM n, range(0, (SELECT ceil(count(*) / 300.0)::BIGINT FROM embeddings)) t(i)""")
def vector_shards(spark, d):
    """Two batches of vectors, which overlap, in shards of 300, which the second batch fills up."""
    shards = VectorShards(spark, new_folder(spark), 64, shard_rows=300)
    every = table(spark, d, "embeddings").select(F.col("vec_id").alias("child_id"), "embedding")
    shards.add(every.where("child_id % 5 < 3"))
    shards.add(every.where("child_id % 5 > 1"))
    bad = shards.issues().groupBy("shard").agg(F.count("*").alias("issues"))
    stored = shards.vectors()
    sizes = stored.groupBy("shard").agg(F.count("*").alias("rows"), F.round(F.max(F.sqrt(retrieve.dot(F.col("embedding"), F.col("embedding")))), 4).alias("longest"))
    return sizes.join(bad, "shard", "left").select(F.col("shard").cast("long").alias("shard"), "rows", F.coalesce("issues", F.lit(0)).alias("issues"), "longest")


@query(f"WITH {_CHUNKS}, n AS (SELECT count(*) AS n FROM chunks) SELECT t AS name, n AS rows, k AS kept, t = 'lexical' AS has_lengths FROM n, (VALUES ('children', true), ('vectors', true), ('lexical', false)) v(t, k)")
def staged_index(spark, d):
    """A version of windows, their ids as vectors and their texts, and one built on it that makes the lexical half anew."""
    versions = IndexVersions(spark, new_folder(spark))
    windows = written(doc_chunks(spark, d))  # cut once for three tables
    tables = {"children": windows.drop("text"), "vectors": windows.select("child_id"), "lexical": windows.select("child_id", "text")}
    total = docs(spark, d).count()
    versions.write("v1", tables, {"documents_total": total, "documents_valid": total, "documents_failed": 0})
    versions.publish("v1")
    manifest = versions.stage("v2", {"lexical": versions.read("v1", "lexical").withColumn("length", F.length("text"))})
    versions.publish("v2")
    rows = None
    for name, place in manifest["tables"].items():  # the few tables of an index
        now = versions.read(versions.current(), name)
        one = now.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows", F.lit(place.startswith("v1/")).alias("kept"), F.lit("length" in now.columns).alias("has_lengths"))
        rows = one if rows is None else rows.unionByName(one)
    return rows
