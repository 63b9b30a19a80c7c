"""Micro-batch ingestion: a file stream of context documents, each batch published as an index version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lexspark.conf import Settings
from lexspark.functions.text import words, windows
from lexspark.plans.ingest import ingest
from lexspark.sources.readers import CONTEXT_FILES, parse_contexts
from lexspark.sources.writers import IndexVersions


def stream_contexts(spark: SparkSession, folder: str, per_batch: int = 100) -> DataFrame:
    """Context files as a stream of parsed documents."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", CONTEXT_FILES)
    return parse_contexts(files.option("maxFilesPerTrigger", per_batch).load(folder))


def start_ingest(spark: SparkSession, folder: str, root: str, checkpoint: str, settings: Settings = Settings(), per_batch: int = 100, report: Callable[[dict], None] = lambda m: None) -> StreamingQuery:
    """Ingests all files that are there, batch by batch; a run that is started again goes on where it stopped.

    A batch that is run again is harmless: its documents' checksums are known, so nothing is done twice.
    """

    def batch(rows: DataFrame, _: int) -> None:
        report(ingest(rows, IndexVersions(spark, root), settings))

    return stream_contexts(spark, folder, per_batch).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_windows(spark: SparkSession, source: str, schema: StructType, size: int, overlap: int) -> DataFrame:
    """Documents of a Parquet source (doc_id, text) as a stream of windows; stateless, so any batch size gives the same rows."""
    rows = spark.readStream.schema(schema).parquet(source)
    cut = rows.select("doc_id", F.explode(windows(words(F.col("text")), size, overlap)).alias("w"))
    return cut.select("doc_id", "w.position", "w.text")
