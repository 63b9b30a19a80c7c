"""Vector shards of a bounded size with id maps, filled up batch by batch and resumed after a crash."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.operators.retrieve import dot
from lexspark.sources.tables import written

#: Parts in which new rows are numbered; their counts are summed up, so no task numbers all rows.
PARTS = 256


class VectorShards:
    """Shards under a folder: `vectors/shard=/batch=` and `maps/shard=/batch=` (child_id, place in the shard).

    A batch counts once its mark `done/N` is there; what a lost driver left without one is written over by the next batch.
    """

    def __init__(self, spark: SparkSession, root: str, dimension: int, shard_rows: int = 50_000, normalise: bool = True, kind: str = "long"):
        if dimension <= 0 or shard_rows <= 0:
            raise ValueError("dimension and shard_rows must be positive")
        self.spark, self.root, self.dimension, self.shard_rows, self.normalise, self.kind = spark, root.rstrip("/"), dimension, shard_rows, normalise, kind
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path, self._fs = path, path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _marks(self) -> dict[int, dict]:
        folder = self._path(f"{self.root}/done")
        out = {}
        for status in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            if status.getPath().getName().isdigit():
                stream = self._fs.open(status.getPath())
                out[int(status.getPath().getName())] = json.loads(bytes(b & 255 for b in stream.readAllBytes()).decode())
                stream.close()
        return dict(sorted(out.items()))

    def _read(self, name: str, schema: str) -> DataFrame:
        paths = [f"{self.root}/{name}/batch={n}" for n in self._marks()]
        schema = f"{schema.format(kind=self.kind)}, batch int, shard int"
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*paths)

    def vectors(self) -> DataFrame:
        return self._read("vectors", "child_id {kind}, embedding array<float>, place int")

    def maps(self) -> DataFrame:
        return self._read("maps", "child_id {kind}, place int")

    def count(self) -> int:
        return sum(m["rows"] for m in self._marks().values())

    def _numbered(self, rows: DataFrame, start: int) -> DataFrame:
        part = F.pmod(F.xxhash64("child_id"), F.lit(PARTS))
        rows = rows.withColumn("_part", part)
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over PARTS rows
        offsets = rows.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
        within = F.row_number().over(Window.partitionBy("_part").orderBy("child_id")) - 1
        number = F.col("_before") + F.col("_n") + F.lit(start)
        placed = rows.withColumn("_n", within).join(F.broadcast(offsets), "_part")  # at most PARTS rows
        return placed.withColumn("shard", F.floor(number / self.shard_rows).cast("int")).withColumn("place", (number % self.shard_rows).cast("int")).drop("_part", "_n", "_before")

    def add(self, rows: DataFrame) -> dict:
        """Adds vectors (child_id, embedding) whose ids aren't stored yet; returns the batch's mark.

        The last shard is filled up before another begins, and none holds more than shard_rows. Of a repeated id one vector
        counts (the least as an array). Null ids, and vectors that are null, hold nulls or have another dimension, are an
        error before anything is written. With `normalise` vectors get length one; a vector of zeros stays.
        """
        new = rows.select("child_id", F.col("embedding").cast("array<float>").alias("embedding"))
        odd = F.col("child_id").isNull() | F.col("embedding").isNull() | (F.size("embedding") != self.dimension) | F.exists("embedding", lambda x: x.isNull())
        bad = new.where(odd).limit(3).collect()
        if bad:
            raise ValueError(f"vectors without an id, of another dimension than {self.dimension}, or with nulls: {[r.child_id for r in bad]}")
        new = new.groupBy("child_id").agg(F.min("embedding").alias("embedding")).join(self.maps().select("child_id"), "child_id", "left_anti")
        if self.normalise:
            size = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
            new = new.withColumn("_s", size).withColumn("embedding", F.when(F.col("_s") > 0, F.transform("embedding", lambda x: (x / F.col("_s")).cast("float"))).otherwise(F.col("embedding"))).drop("_s")
        n, start = 1 + max(self._marks(), default=0), self.count()
        placed = written(self._numbered(new, start))
        for name, columns in (("vectors", ["child_id", "embedding", "place"]), ("maps", ["child_id", "place"])):
            placed.select(*columns, "shard").repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(f"{self.root}/{name}/batch={n}")
        mark = {"rows": placed.count(), "first": start, "dimension": self.dimension, "shard_rows": self.shard_rows}
        stream = self._fs.create(self._path(f"{self.root}/done/{n}"), True)
        stream.write(bytearray(json.dumps(mark).encode()))
        stream.close()
        return mark

    def issues(self) -> DataFrame:
        """(issue, shard, child_id): what keeps the shards from being searched: rows that a mark promises and a shard lacks or
        has too many of, ids twice, places twice, vectors without a map entry and the other way round."""
        marks = self._marks()
        total = sum(m["rows"] for m in marks.values())
        shards = max(1, -(-total // self.shard_rows))
        none = lambda c: F.lit(None).cast(c)
        out = None
        for name, rows in (("vectors", self.vectors()), ("maps", self.maps())):
            wanted = self.spark.range(shards).select(F.col("id").cast("int").alias("shard"), F.least(F.lit(self.shard_rows), F.lit(total) - F.col("id") * self.shard_rows).alias("_want"))
            sizes = rows.groupBy("shard").agg(F.count("*").alias("_have"))
            size = wanted.join(sizes, "shard", "full").where("coalesce(_want, 0) <> coalesce(_have, 0)").select(F.lit(f"{name}: rows missing or too many").alias("issue"), "shard", none(self.kind).alias("child_id"))
            ids = rows.groupBy("child_id").count().where("count > 1").select(F.lit(f"{name}: an id twice").alias("issue"), none("int").alias("shard"), "child_id")
            places = rows.groupBy("shard", "place").count().where("count > 1").select(F.lit(f"{name}: a place twice").alias("issue"), "shard", none(self.kind).alias("child_id")).distinct()
            for found in (size, ids, places):
                out = found if out is None else out.unionByName(found)
        key = ["child_id", "shard", "place"]
        apart = self.vectors().join(self.maps(), key, "left_anti").select(F.lit("a vector without a map entry").alias("issue"), "shard", "child_id")
        alone = self.maps().join(self.vectors(), key, "left_anti").select(F.lit("a map entry without a vector").alias("issue"), "shard", "child_id")
        return out.unionByName(apart).unionByName(alone)
