"""The training-data pipeline over documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexspark.llm.common import table, written
from lexspark.llm.jaccard import near_copies_stage
from lexspark.llm.packing import packing_stage
from lexspark.llm.pii import pii_stage
from lexspark.llm.quality import quality_stage
from lexspark.llm.toxicity import toxicity_stage

#: In order; each takes (spark, docs, sf_dir) and works on all that the one before has kept.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_copies", near_copies_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]
#: SQL can express neither the trained classifiers nor the packing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each to what the one before has kept."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    for _, stage in STAGES[-1:]:
        docs = stage(spark, docs, sf_dir)
    return docs
