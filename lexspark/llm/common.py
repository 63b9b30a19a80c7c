"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


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


def written(df: DataFrame) -> DataFrame:
    """The rows of df as a table in the shared folder: the lineage is cut, and what follows survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """The same rows, after the session's Arrow batches have been limited to so many rows: whole texts are long, and the JVM
    and the Python worker each hold a batch at a time. A smaller limit of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(name, "10000"))
    if not 0 < now <= rows:
        df.sparkSession.conf.set(name, str(rows))
    return df


def slices(batches: Iterable[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows: texts become Python objects a few at a time."""
    for batch in batches:
        for low in range(0, len(batch), rows):
            yield batch.slice(low, rows)


def give_back() -> None:
    """Returns freed memory to the system, which allocators keep otherwise; workers and the driver live on after a task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of unsigned 64-bit numbers over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Roots:
    """Union by smallest member over the numbers 0..n-1, with path halving."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _forest(batches: Iterator[pa.RecordBatch], rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Replaces edges, about so many at a time, by edges from their nodes to the smallest node they reach among them."""

    def merged(waiting: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([w.column(i).to_numpy(zero_copy_only=False) for w in waiting]) for i in (0, 1))
        names, where = np.unique(np.concatenate([a, b]), return_inverse=True)
        roots = Roots(len(names))
        for x, y in zip(where[: len(a)].tolist(), where[len(a) :].tolist()):
            roots.join(x, y)
        to = np.array([roots.root(x) for x in range(len(names))], np.int64)
        keep = to != np.arange(len(names))
        return pa.RecordBatch.from_arrays([pa.array(names[keep]), pa.array(names[to[keep]])], names=["a", "b"])

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(map(len, waiting)) >= rows:
            yield merged(waiting)
            waiting = []
    if waiting:
        yield merged(waiting)
    give_back()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges (a long, b long).

    Returns (node, component): for every node with an edge to another node the smallest node it reaches.
    Large-star and small-star steps alternate until nothing changes. Minima are aggregated before the shuffle,
    so a hub with very many edges costs no single task more than its share, and no edge goes to the driver.
    Loops and repeated edges are ignored; without edges the result is empty.
    """
    current = written(
        edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(_forest, "a long, b long").distinct()
    )
    seen = None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        seen = state
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        current = written(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct())
