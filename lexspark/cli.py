"""Command line: ingest, answer, submit, validate-submission, evaluate-grounding, run.

    python -m lexspark.cli ingest CORPUS INDEX
    python -m lexspark.cli answer QUESTIONS INDEX OUTPUT [--start N] [--end N]
    python -m lexspark.cli submit QUESTIONS INDEX OUTPUT
    python -m lexspark.cli validate-submission SUBMISSION [--questions FILE]
    python -m lexspark.cli evaluate-grounding GOLD PREDICTED
    python -m lexspark.cli run QUERY FOLDER OUTPUT
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.conf import Settings
from lexspark.operators import evaluate
from lexspark.plans import answer, search
from lexspark.plans.ingest import ingest
from lexspark.sources import readers, writers


def _answers(spark: SparkSession, questions: DataFrame, index: str, settings: Settings) -> DataFrame:
    versions = writers.IndexVersions(spark, index)
    now = versions.current()
    if not now:
        raise SystemExit("no version of the index is published")
    children = versions.read(now, "children")
    asked = questions.withColumnRenamed("question", "text")
    found = search.contexts(asked, children, settings)
    one = F.struct("rank", F.col("document_id"), "text")
    evidence = found.groupBy("question_id").agg(F.array_sort(F.collect_list(one)).alias("e"))
    told = F.transform("e", lambda x: F.struct(x["document_id"].alias("document_id"), x["text"].alias("text")))
    rows = asked.join(evidence, "question_id", "left").select("question_id", "text", F.coalesce(told, F.array().cast("array<struct<document_id:bigint,text:string>>")).alias("evidence"))
    return answer.generate_answers(rows)


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lexspark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, places in {
        "ingest": ["corpus", "index"],
        "answer": ["questions", "index", "output"],
        "submit": ["questions", "index", "output"],
        "validate-submission": ["submission"],
        "evaluate-grounding": ["gold", "predicted"],
        "run": ["query", "folder", "output"],
    }.items():
        one = commands.add_parser(name)
        for place in places:
            one.add_argument(place)
        if name == "answer":
            one.add_argument("--start", type=int, default=0)
            one.add_argument("--end", type=int)
        if name == "validate-submission":
            one.add_argument("--questions")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("lexspark").getOrCreate()
    settings = Settings.from_environment()
    if given.command == "ingest":
        print(json.dumps(ingest(readers.read_contexts(spark, given.corpus), writers.IndexVersions(spark, given.index), settings)))
    elif given.command in ("answer", "submit"):
        questions = readers.read_questions(spark, given.questions)
        if given.command == "answer":
            place = F.row_number().over(Window.orderBy("question_id")) - 1  # questions are few
            questions = questions.withColumn("_n", place).where((F.col("_n") >= given.start) & (F.col("_n") < (given.end if given.end is not None else 2**31 - 1))).drop("_n")
        rows = answer.submission_rows(_answers(spark, questions, given.index, settings), require_grounded=given.command == "answer")
        found = writers.write_submission(rows, given.output, [r["question_id"] for r in questions.select("question_id").collect()])
        print(f"{len(found)} answers")
    elif given.command == "validate-submission":
        with open(given.submission, encoding="utf-8") as f:
            found = writers.read_submission(f.read())
        if given.questions:
            wanted = {r["question_id"] for r in readers.read_questions(spark, given.questions).collect()}
            if wanted != set(found):
                print(f"missing: {sorted(wanted - set(found))[:5]}, unexpected: {sorted(set(found) - wanted)[:5]}")
                return 1
        print(f"{len(found)} answers are valid")
    elif given.command == "evaluate-grounding":
        gold = readers.read_latest_lines(spark, given.gold, "question_id string, gold_grounded boolean", "question_id")
        predicted = readers.read_latest_lines(spark, given.predicted, "question_id string, validator_grounded boolean", "question_id")
        print(json.dumps(evaluate.confusion(gold.join(predicted, "question_id"), "gold_grounded", "validator_grounded").first().asDict()))
    else:
        from lexspark.plans import catalog

        catalog.QUERIES[given.query](spark, given.folder).write.mode("errorifexists").parquet(given.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
