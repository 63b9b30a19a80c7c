"""Answering: prompts, generation by a pluggable provider, validation, one repair, submission rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions.answers import normalise_answer
from lexspark.functions.text import token_count, words
from lexspark.operators import validate
from lexspark.sources import writers

Provider = Callable[[pd.Series, pd.Series], pd.Series]


def extractive(question: pd.Series, evidence: pd.Series) -> pd.Series:
    """The first sentence of the first evidence, cited: a stand-in for a language model."""
    return pd.Series([f"{str(e[0]['text']).split('. ')[0].strip().rstrip('.')} [1]." if e is not None and len(e) else "" for e in evidence])


def _guarded(provider: Provider):
    """The provider as a column of (answer, error): where a batch fails its questions are asked one by one, so that one
    failure costs one answer."""

    @F.pandas_udf("answer string, error string")
    def generated(question: pd.Series, evidence: pd.Series) -> pd.DataFrame:
        try:
            answers, errors = list(provider(question, evidence)), [None] * len(question)
        except Exception:
            answers, errors = [], []
            for i in range(len(question)):
                try:
                    answers.append(provider(question.iloc[i : i + 1], evidence.iloc[i : i + 1]).iloc[0])
                    errors.append(None)
                except Exception as failure:
                    answers.append(None)
                    errors.append(f"{type(failure).__name__}: {failure}")
        return pd.DataFrame({"answer": pd.Series(answers, dtype=object), "error": pd.Series(errors, dtype=object)})

    return generated("text", "evidence")


def repair_prompt(question: Column, answer: Column, errors: Column, evidence: Column, fields: tuple[str, ...] = ("document_name", "article", "clause", "point", "source_link")) -> Column:
    """What a repair is asked: the question, the answer and its errors, and the evidence with its fields, numbered."""
    numbered = F.transform(evidence, lambda e, i: F.concat_ws("\n", F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]")), *[F.when(e[f] != "", F.concat(F.lit(f"{f}: "), e[f])) for f in fields], e["text"]))
    return F.concat_ws("\n\n", question, answer, F.array_join(errors, "\n"), F.array_join(numbered, "\n\n"))


def failures(answers: DataFrame) -> DataFrame:
    """(question_id, error, failure): the log of questions that got no answer."""
    return answers.where("error is not null").select("question_id", "error", writers.failure_type(F.col("error")).alias("failure"))


def generate_answers(
    questions: DataFrame, provider: Provider = extractive, repair: Provider | None = None, require_citation: bool = True, repair_tokens: int = 192, max_context: int | None = None
) -> DataFrame:
    """Answers to questions (question_id, text, evidence: array of structs with text), validated, repaired at most once.

    Questions whose evidence has no text get the abstention; where the provider fails the answer is null and `error` says
    why. A repaired answer ends after `repair_tokens` words; a repair whose prompt leaves no room for them within
    `max_context`, or that comes back empty, fails and costs that answer. Returns question_id, answer, error, abstained, repaired,
    grounded, grounding_errors and the columns of the citation check.
    """
    abstain = validate.should_abstain(F.col("evidence.text"))
    made = questions.withColumn("abstained", abstain).withColumn("_made", _guarded(provider))
    answer = F.when(F.col("abstained"), validate.ABSTENTION).otherwise(F.col("_made.answer"))
    rows = made.withColumn("answer", answer).withColumn("error", F.when(~F.col("abstained"), F.col("_made.error"))).drop("_made")
    checked = validate.validate_grounding(validate.validate_citations(rows.withColumn("n_evidence", F.size("evidence")), require_citation))
    if repair is None:
        return checked.withColumn("repaired", F.lit(False))
    again = ~F.col("abstained") & F.col("error").isNull() & validate.repair_eligible(F.col("grounding_errors"))
    columns = rows.columns
    broken = checked.where(again)
    asked = token_count(repair_prompt(F.col("text"), F.col("answer"), F.col("grounding_errors"), F.col("evidence")))
    full = asked + repair_tokens > max_context if max_context is not None else F.lit(False)
    why = F.concat(F.lit("RepairTooLong: prompt="), asked, F.lit(f", generation={repair_tokens}, limit={max_context}"))
    late = broken.withColumn("_full", full).where("_full").withColumn("error", why).withColumn("answer", F.lit(None).cast("string")).drop("_full")
    fixed = broken.withColumn("_full", full).where("not _full").select(columns).withColumn("_made", _guarded(repair))
    short = F.array_join(F.slice(words(F.col("_made.answer")), 1, repair_tokens), " ")
    long = F.size(words(F.col("_made.answer"))) > repair_tokens
    answer = F.nullif(F.trim(F.when(long, short).otherwise(F.col("_made.answer"))), F.lit(""))
    fixed = fixed.withColumn("answer", answer).withColumn("error", F.coalesce("_made.error", F.when(answer.isNull(), "EmptyRepair: the repair has no text"))).drop("_made")
    fixed = validate.validate_grounding(validate.validate_citations(fixed.withColumn("n_evidence", F.size("evidence")), require_citation))
    done = checked.where(~again).withColumn("repaired", F.lit(False)).unionByName(fixed.withColumn("repaired", F.lit(True)))
    return done if max_context is None else done.unionByName(late.withColumn("repaired", F.lit(False)))


def submission_rows(answers: DataFrame, done: DataFrame | None = None, fallback: str = validate.ABSTENTION, require_grounded: bool = False) -> DataFrame:
    """(question_id, answer): normalised answers; those of `done` (an earlier run) come first, failed ones get the fallback.

    A question id that is missing or repeated is an error when the rows are read.
    """
    fresh = answers if done is None else answers.join(done, "question_id", "left_anti")
    bad = F.col("answer").isNull() | (~F.col("grounded") if require_grounded else F.lit(False))
    times = F.count("*").over(Window.partitionBy("question_id"))
    wrong = F.when(F.col("question_id").isNull(), F.raise_error(F.lit("an answer has no question_id"))).when(times > 1, F.raise_error(F.concat(F.lit("repeated question_id: "), F.col("question_id").cast("string"))))
    fresh = fresh.withColumn("_wrong", wrong.cast("string")).where("_wrong is null")
    rows = fresh.select("question_id", F.when(bad, F.lit(fallback)).otherwise(normalise_answer(F.col("answer"))).alias("answer"))
    return rows if done is None else rows.unionByName(done.select("question_id", "answer"))
