"""Answering in batches: prompts of like length share a call, each answer its time, and the order of the requests stays."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.functions.text import token_count

#: Answers to a batch of prompts, in their order.
Batched = Callable[[list[str]], list[str]]
ANSWERS = "question_id {kind}, ordinal long, tokens long, answer string, error string, batch string, batch_rows int, seconds double"


def answer_batches(requests: DataFrame, provider: Batched, batch: int, max_context: int, new_tokens: int) -> DataFrame:
    """Answers to requests (question_id, ordinal, prompt): (question_id, ordinal, tokens, answer, error, batch, batch_rows, seconds).

    Each task sorts its prompts by length and sends `batch` of them at a time, so little padding is wasted. `seconds` is a
    request's share of its batch's time; shares of a batch add up to that time. A prompt that leaves no room for
    `new_tokens` within `max_context` isn't sent: it costs its own answer and says why in `error`. A batch that fails is
    sent again prompt by prompt. A null prompt is empty. `ordinal` numbers the requests: order by it, or join by
    question_id, and the requests' order is back; requests that repeat are answered each.
    """
    if batch < 1:
        raise ValueError("a batch holds at least one prompt")
    kind = requests.schema["question_id"].dataType.simpleString()
    rows = requests.select("question_id", F.col("ordinal").cast("long").alias("ordinal"), F.coalesce("prompt", F.lit("")).alias("prompt"))
    rows = rows.withColumn("tokens", token_count(F.col("prompt"))).withColumn("_long", F.col("tokens") + new_tokens > max_context)

    def answered(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, number, waiting = TaskContext.get().partitionId(), 0, None
        for part in parts:
            waiting = part if waiting is None else pd.concat([waiting, part])
            while len(waiting) >= batch:
                yield one(waiting.iloc[:batch], f"{task}:{number}")
                waiting, number = waiting.iloc[batch:], number + 1
        if waiting is not None and len(waiting):
            yield one(waiting, f"{task}:{number}")

    def one(some: pd.DataFrame, name: str) -> pd.DataFrame:
        prompts, began = some["prompt"].tolist(), time.perf_counter()
        try:
            answers, errors = list(provider(prompts)), [None] * len(prompts)
            if len(answers) != len(prompts):
                raise ValueError(f"{len(answers)} answers to {len(prompts)} prompts")
        except Exception:
            answers, errors = [], []
            for prompt in prompts:
                try:
                    answers.append(provider([prompt])[0])
                    errors.append(None)
                except Exception as failure:
                    answers.append(None)
                    errors.append(f"{type(failure).__name__}: {failure}")
        answers = [None if a is None else a.strip() for a in answers]
        share = (time.perf_counter() - began) / len(prompts)
        return pd.DataFrame({"question_id": some["question_id"], "ordinal": some["ordinal"], "tokens": some["tokens"], "answer": pd.Series(answers, some.index, object), "error": pd.Series(errors, some.index, object), "batch": name, "batch_rows": len(some), "seconds": share})

    fits = rows.where("not _long").select("question_id", "ordinal", "prompt", "tokens").repartition("ordinal").sortWithinPartitions("tokens", "ordinal")
    done = fits.mapInPandas(answered, ANSWERS.format(kind=kind))
    none = lambda c: F.lit(None).cast(c)
    why = F.concat(F.lit("PromptTooLong: prompt="), F.col("tokens"), F.lit(f", generation={new_tokens}, limit={max_context}"))
    late = rows.where("_long").select("question_id", "ordinal", "tokens", none("string").alias("answer"), why.alias("error"), none("string").alias("batch"), none("int").alias("batch_rows"), F.lit(0.0).alias("seconds"))
    return done.unionByName(late)


def batch_times(answers: DataFrame) -> DataFrame:
    """(batch, rows, seconds, shortest, longest): what each batch took, and the lengths that shared it."""
    return answers.where("batch is not null").groupBy("batch").agg(F.count("*").alias("rows"), F.sum("seconds").alias("seconds"), F.min("tokens").alias("shortest"), F.max("tokens").alias("longest"))


def append_failures(answers: DataFrame, path: str) -> int:
    """Appends the failed questions of answers (question_id, error) to a log of JSON lines; returns how many there are."""
    from lexspark.plans.answer import failures
    from lexspark.sources.tables import written

    found = written(failures(answers).withColumn("logged_at", F.current_timestamp().cast("string")))
    found.write.mode("append").json(path)
    return found.count()
