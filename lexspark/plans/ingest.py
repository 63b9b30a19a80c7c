"""Ingestion: from found documents to a published index version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.conf import Settings
from lexspark.functions.text import clean_text
from lexspark.operators.chunks import integrity, parent_child_chunks
from lexspark.operators.retrieve import hashed_embedding
from lexspark.sources.writers import IndexVersions, pending_documents, upsert, without_documents

TABLES = ("documents", "parents", "children", "vectors", "lexical")


def ingest(found: DataFrame, versions: IndexVersions, settings: Settings = Settings(), version: str | None = None) -> dict:
    """Adds parsed documents (as read_contexts gives them) to the current version and publishes the result.

    Documents that are already done are skipped; bad ones (an error, or a blank text) are kept as failed. The new version
    is published only if its counts agree and no integrity rule is broken. Returns the manifest.
    """
    spark, now = found.sparkSession, versions.current()
    text = clean_text(F.col("text"))
    found = found.withColumn("text", text).withColumn("error", F.coalesce("error", F.when(F.coalesce(text, F.lit("")) == "", "the text is blank")))
    found = found.withColumn("document_key", F.coalesce(F.col("document_id").cast("string"), "path"))
    old = {t: versions.read(now, t) for t in TABLES} if now else {}
    fresh = found
    if now:
        state = old["documents"].select(F.col("document_key").alias("document_id"), "checksum", "status", F.lit(True).alias("stored"))
        fresh = pending_documents(found.withColumn("_id", F.col("document_id")).withColumn("document_id", F.col("document_key")), state).withColumn("document_id", F.col("_id")).drop("_id")
    good = fresh.where("error is null")
    parents, children = parent_child_chunks(good.select("document_id", "document_name", "source_link", "text"), settings)
    status = F.when(F.col("error").isNull(), "completed").otherwise("failed")
    new = {
        "documents": fresh.select("document_key", "document_id", "document_name", "source_link", "checksum", status.alias("status"), "error"),
        "parents": parents,
        "children": children,
        "vectors": children.select("child_id", "document_id", hashed_embedding(F.col("embedding_text")).alias("embedding")),
        "lexical": children.select("child_id", "document_id", F.col("embedding_text").alias("text")),
    }
    if now:
        gone = fresh.select("document_id").where("document_id is not null").distinct()
        new = {t: upsert(old[t], rows, "document_key") if t == "documents" else without_documents(old[t], gone).unionByName(rows) for t, rows in new.items()}
    version = version or versions.next_version()
    kept = new["documents"]
    counts = kept.agg(F.count("*").alias("n"), F.count(F.when(F.col("status") == "completed", 1)).alias("valid")).first()
    manifest = {"documents_total": counts["n"], "documents_valid": counts["valid"], "documents_failed": counts["n"] - counts["valid"], "dimension": 256}
    manifest = versions.write(version, new, manifest)
    broken = integrity(versions.read(version, "documents"), versions.read(version, "parents"), versions.read(version, "children")).where("violations > 0").count()
    if manifest["status"] == "ready" and not broken:
        versions.publish(version)
    spark.catalog.clearCache()
    failed = fresh.where("error is not null").groupBy("error").count().orderBy(F.desc("count"), "error").limit(20).collect()
    result = manifest | {"broken_rules": broken, "failures": {r.error: r["count"] for r in failed}, "published": versions.current() == version}
    versions.report(version, result)
    return result

