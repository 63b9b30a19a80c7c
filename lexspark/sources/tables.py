"""Tables that a plan writes on its way, and rows spread over a cluster."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of ids that every executor may hold to pick out the texts they name.
HELD_ROWS = 300_000

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only where it is unset and all run
    on one machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own_folder:
            _own_folder.append("file://" + tempfile.mkdtemp(prefix="spark-"))
        folder = _own_folder[0]
    return folder.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """A folder in the shared one that nothing else uses."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def written(rows: DataFrame) -> DataFrame:
    """The same rows as a Parquet table in the shared folder: the lineage is cut, and lost executors cost nothing before it."""
    spark, path = rows.sparkSession, new_folder(rows.sparkSession)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """The same rows over all cores where the scan is too small to give each core a split of its own: a file of one row group
    is one task otherwise, whatever is computed from its rows. A larger scan stays as it is, without a shuffle."""
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < cores * split else rows


def small_batches(rows: DataFrame, most: int = 1000) -> DataFrame:
    """The same rows, after the session's Arrow batches have been limited to so many: whole texts are long, and the JVM and a
    Python worker each hold a batch at a time. A smaller limit of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(rows.sparkSession.conf.get(name, "10000"))
    if not 0 < now <= most:
        rows.sparkSession.conf.set(name, str(most))
    return rows


def picked(few: DataFrame, many: DataFrame, by: str) -> DataFrame:
    """The rows of `many` (a table of texts) that `few` (rows of ids) name, joined. Up to HELD_ROWS ids go to the texts, which
    are neither shuffled nor sorted then; more take a shuffle of both."""
    few = written(few)
    return many.join(F.broadcast(few) if few.count() <= HELD_ROWS else few, by)


def give_back() -> None:
    """Returns freed memory to the system: Python workers live on after a task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)
