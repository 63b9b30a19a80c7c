"""Readers of context documents, questions and JSON-lines artifacts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CONTEXT_FILES = "context_*.json"
_RECORD = "id long, name string, link string, passage string"


def read_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """Context files as rows: path, checksum, document_id, document_name, source_link, text, error.

    A record is strict: an integer id, a link that is not empty; other keys are ignored. Bad files keep their row with an
    error and null fields. An empty name is null; a null passage is empty.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", CONTEXT_FILES).load(folder)
    return parse_contexts(files)


def parse_contexts(files: DataFrame) -> DataFrame:
    """Parses rows of (path, content)."""
    text = F.regexp_replace(F.decode(F.col("content"), "UTF-8"), "^﻿", "")
    raw = files.select("path", F.sha2("content", 256).alias("checksum"), text.alias("raw")).withColumn("r", F.from_json("raw", _RECORD))
    kind = lambda k: F.get_json_object("raw", f"$.{k}")
    wrong = lambda k: F.col(f"r.{k}").isNull() & kind(k).isNotNull()
    # the type of a key of the record itself; keys of the same name inside other values don't matter
    at = lambda k: F.try_variant_get(F.try_parse_json("raw"), f"$.{k}", "variant")
    quoted = lambda k: ~F.coalesce(F.schema_of_variant(at(k)), F.lit("VOID")).isin("STRING", "VOID")
    error = (
        F.when(F.col("r").isNull() | (F.trim("raw") == "") | ~F.ltrim("raw").startswith("{"), "the file is not a JSON object")
        .when(F.col("r.id").isNull(), "id is missing or not an integer")
        .when(wrong("link") | quoted("link") | (F.coalesce(F.length("r.link"), F.lit(0)) == 0), "link is missing or empty")
        .when(quoted("name") | quoted("passage"), "name and passage must be text")
    )
    rows = raw.withColumn("error", error)
    good = F.col("error").isNull()
    return rows.select(
        "path",
        "checksum",
        F.when(good, F.col("r.id")).alias("document_id"),
        F.when(good, F.nullif(F.regexp_replace("r.name", r"(?U)^\s+|\s+$", ""), F.lit(""))).alias("document_name"),
        F.when(good, F.col("r.link")).alias("source_link"),
        F.when(good, F.coalesce("r.passage", F.lit(""))).alias("text"),
        "error",
    )


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions (question_id, question) from .json (a list, one object, or an object by id), .jsonl or .csv.

    Ids and questions are stripped; blank ids, blank questions and repeated ids raise an error.
    """
    strip = lambda c: F.regexp_replace(F.regexp_replace(c, "^﻿", ""), r"(?U)^\s+|\s+$", "")
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        rows = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
        rows = rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns]).select(F.col("question_id").cast("string"), "question")
    elif kind == "jsonl":
        lines = spark.read.text(path).where("trim(value) <> ''")
        rows = lines.select(F.from_json(strip(F.col("value")), "question_id string, question string").alias("r")).select("r.*")
    elif kind == "json":
        raw = spark.read.text(path, wholetext=True).select(strip(F.col("value")).alias("raw"))
        record = "question_id string, question string"
        listed = raw.where("raw like '[%'").select(F.explode(F.from_json("raw", f"array<struct<{record.replace(' s', ':s')}>>")).alias("r")).select("r.*")
        single = F.get_json_object("raw", "$.question_id").isNotNull() & F.get_json_object("raw", "$.question").isNotNull()
        objects = raw.where("raw like '{%'")
        one = objects.where(single).select(F.from_json("raw", record).alias("r")).select("r.*")
        keyed = objects.where(~single).select(F.explode(F.from_json("raw", "map<string,string>")).alias("question_id", "v"))
        keyed = keyed.select("question_id", F.coalesce(F.get_json_object("v", "$.question"), F.when(~F.col("v").startswith("{"), F.col("v"))).alias("question"))
        rows = listed.unionByName(one).unionByName(keyed)
    else:
        raise ValueError(f"unknown kind of question file: {kind}")
    rows = rows.select(strip(F.col("question_id")).alias("question_id"), strip(F.col("question")).alias("question"))
    blank = F.count(F.when(F.coalesce(F.col("question_id"), F.lit("")).eqNullSafe("") | F.coalesce(F.col("question"), F.lit("")).eqNullSafe(""), 1))
    bad = rows.agg(blank.alias("blank"), (F.count("*") - F.count_distinct("question_id")).alias("repeated")).first()
    if bad["blank"] or bad["repeated"]:
        raise ValueError(f"{bad['blank']} questions are blank, {bad['repeated']} ids are repeated")
    return rows


def read_latest_lines(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """JSON lines, torn and blank ones skipped; of rows with the same key the last one stays."""
    lines = spark.read.text(path).withColumn("_n", F.monotonically_increasing_id())
    rows = lines.select("_n", F.from_json("value", schema).alias("r")).where(F.col(f"r.{key}").isNotNull()).select("_n", "r.*")
    last = Window.partitionBy(key).orderBy(F.desc("_n"))
    return rows.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "_n")


#: What is read of a log entry.
_ENTRY = "step long, epoch double, learning_rate double, loss double, eval_loss double, grad_norm double, eval_runtime double"


def training_log(spark: SparkSession, run: str) -> DataFrame:
    """The merged log of a training run: (step, split, epoch, learning_rate, loss, grad_norm, runtime_seconds).

    Every `checkpoint-N/trainer_state.json` under the run holds the log up to it, so that checkpoints that were deleted lose
    nothing; of a step's entries of a split (eval if there is an evaluation loss, else train) the latest checkpoint's last
    one counts. An entry without a step has step -1, without an epoch epoch 0. Files that aren't JSON give no entries.
    """
    states = spark.read.schema(f"log_history array<struct<{_ENTRY.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", True).json(f"{run.rstrip('/')}/checkpoint-*/trainer_state.json")
    number = F.regexp_extract(F.col("_metadata.file_path"), r"checkpoint-(\d+)/", 1).cast("long")
    entries = states.select(number.alias("_checkpoint"), F.posexplode("log_history").alias("_at", "e")).select("_checkpoint", "_at", "e.*")
    entries = entries.withColumn("step", F.coalesce("step", F.lit(-1))).withColumn("split", F.when(F.col("eval_loss").isNotNull(), "eval").otherwise("train"))
    last = Window.partitionBy("step", "split").orderBy(F.desc("_checkpoint"), F.desc("_at"))
    rows = entries.withColumn("_r", F.row_number().over(last)).where("_r = 1")
    return rows.select(
        "step", "split", F.bround(F.coalesce("epoch", F.lit(0.0)), 4).alias("epoch"), "learning_rate", F.coalesce("loss", "eval_loss").alias("loss"), "grad_norm", F.col("eval_runtime").alias("runtime_seconds")
    )


class UnsupportedDocument(ValueError):
    """No reader takes a path."""


#: Readers by what the names of their files end with, in the order in which they are asked.
READERS: list[tuple[tuple[str, ...], Callable[[SparkSession, str], DataFrame]]] = [((".json",), read_contexts)]


def reader_of(path: str) -> Callable[[SparkSession, str], DataFrame]:
    """The first reader that takes a path, a file or a pattern; a folder is one of JSON records."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    for endings, reader in READERS:
        if name.endswith(endings) or "." not in name:
            return reader
    raise UnsupportedDocument(f"no reader for {path}")
