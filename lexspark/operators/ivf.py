"""An approximate dense index: vectors in lists by their nearest of a few learned directions, searched list by list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.operators.retrieve import best_of_meetings, top

#: Vectors that directions are learned from, at most so many for each list: a bound, whatever the table's size.
SAMPLE_PER_LIST = 256


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def learned_directions(vectors: DataFrame, lists: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Unit directions by spherical k-means on a sample of vectors (child_id, embedding).

    The sample is the SAMPLE_PER_LIST * lists vectors of the least hashed ids, so it is the same for every partitioning and
    never grows beyond that. Null and empty vectors are not taken. Fewer vectors than lists give as many directions.
    """
    order = F.xxhash64(F.lit(seed), "child_id")
    rows = vectors.where("size(embedding) > 0").select("embedding", order.alias("_o")).orderBy("_o").limit(SAMPLE_PER_LIST * lists).collect()
    if not rows:
        return np.zeros((0, 0))
    points = _unit(np.array([r.embedding for r in rows], float))
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(lists, len(points)), replace=False)]
    for _ in range(rounds):
        near = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        empty = ~np.bincount(near, minlength=len(centres)).astype(bool)
        centres = _unit(sums)
        if empty.any():  # an empty list starts anew where the sample fits worst
            worst = np.argsort((points * centres[near]).sum(axis=1))[: int(empty.sum())]
            centres[empty] = points[worst]
    return centres


def with_lists(rows: DataFrame, directions: np.ndarray, probes: int = 1, column: str = "embedding") -> DataFrame:
    """Each row once for each of its `probes` nearest directions, with `list`, that direction's number, and `near`, its cosine."""
    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    schema = StructType([*rows.schema.fields, StructField("list", IntegerType()), StructField("near", DoubleType())])
    n = min(probes, len(directions))

    def dealt(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if not len(part) or not n:
                continue
            scores = _unit(np.stack(part[column]).astype(float)) @ directions.T
            best = np.argpartition(-scores, n - 1, axis=1)[:, :n]
            out = part.loc[part.index.repeat(n)].reset_index(drop=True)
            out["list"] = best.ravel().astype(np.int32)
            out["near"] = np.take_along_axis(scores, best, axis=1).ravel()
            yield out

    return rows.where(f"size({column}) > 0").mapInPandas(dealt, schema)


def write_lists(vectors: DataFrame, directions: np.ndarray, path: str) -> None:
    """Stores vectors (child_id, embedding) in folders by list, every row in one list."""
    with_lists(vectors, directions).repartition("list", F.pmod(F.xxhash64("child_id"), F.lit(16))).write.mode("overwrite").partitionBy("list").parquet(path)


def ivf_top_k(queries: DataFrame, lists: DataFrame, directions: np.ndarray, k: int, probes: int | None = None, apart: bool = False, query_block: int = 1024, slice_rows: int = 4096) -> DataFrame:
    """The k vectors of the largest inner product for each query (question_id, embedding) among its `probes` nearest lists.

    `lists` has (child_id, embedding, list), stored by write_lists or made by with_lists; None probes all lists, which is
    exact. Scores are exact inner products in either case. A large list meets the queries in slices of about `slice_rows`
    vectors, and many queries in blocks, so one list may hold any share of the vectors.
    """
    asked = with_lists(queries.select("question_id", "embedding"), directions, len(directions) if probes is None else probes).select("question_id", F.col("embedding").alias("_query"), "list")
    slices = F.greatest(F.lit(1), F.ceil(F.col("count") / slice_rows)).cast("int")
    sizes = lists.groupBy("list").count().select("list", slices.alias("slices"))
    blocks = asked.groupBy("list").count().select("list", F.greatest(F.lit(1), F.ceil(F.col("count") / query_block)).cast("int").alias("blocks"))
    # one row a list, and lists are bounded by the directions, which each task holds anyway
    plan = F.broadcast(sizes.join(blocks, "list"))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = lists.select("child_id", "embedding", "list").join(plan, "list").withColumn("slice", dealt("child_id", "slices")).withColumn("block", each("blocks"))
    right = asked.join(plan, "list").withColumn("block", dealt("question_id", "blocks")).withColumn("slice", each("slices"))
    found = best_of_meetings(left.select("child_id", "embedding", "list", "slice", "block"), right.select("question_id", "_query", "list", "slice", "block"), ["list", "slice", "block"], k, apart)
    return top(found, ["question_id"], "score", "child_id", k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: how many of the exact lists' pairs (question_id, child_id) were found, and their share."""
    both = exact.select("question_id", "child_id").join(found.select("question_id", "child_id", F.lit(1).alias("_f")), ["question_id", "child_id"], "left")
    return both.agg(F.count("*").alias("pairs"), F.count("_f").alias("found")).withColumn("recall", F.col("found") / F.col("pairs"))
