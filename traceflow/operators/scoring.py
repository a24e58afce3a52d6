"""Score prompts in batches with a function the caller supplies."""

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceflow.operators.joins import lookup_join
from traceflow.session import checkpoint

# A chat as a list of (role, content) pairs in, an answer out.
Scorer = Callable[[list[tuple[str, str]]], str | None]
# Several chats in, as many answers out.
BatchScorer = Callable[[list[list[tuple[str, str]]]], list[str | None]]

# Answers as they are stored, by the hash of the prompt.
ANSWERS = "_key string, _answer string, _error string"
# Failures that are worth another try.
PASSING = (TimeoutError, ConnectionError)


def previous_answer(messages: list[tuple[str, str]]) -> str | None:
    """A local scorer: repeat the last answer told in the prompt."""
    told = [content for role, content in messages[1:] if role == "assistant"]
    return told[-1] if told else None


def score_prompts(
    prompts: DataFrame,
    scorer: Scorer,
    retries: int = 3,
    pause: float = 1.0,
    column: str = "pred",
    retry_on: tuple[type[Exception], ...] = (Exception,),
    error: str | None = None,
) -> DataFrame:
    """Add the scorer's answer to every row; NULL when all tries failed.

    Only exceptions of ``retry_on`` are tried again, any other stops the job.
    ``error`` names a column for the text of the last exception of a failed row.

    Rows stay in their partitions and answers stay with their rows. The scorer
    may be asked again for a row whose task is run again.
    """
    added = [T.StructField(c, T.StringType()) for c in (column, error) if c]
    schema = T.StructType([*prompts.schema.fields, *added])

    def ask(messages) -> tuple[str | None, str | None]:
        chat = [(m["role"], m["content"]) for m in messages]
        failure = None
        for attempt in range(retries + 1):
            try:
                return scorer(chat), None
            except retry_on as reason:
                failure = repr(reason)
                if attempt < retries:
                    time.sleep(pause)
        return None, failure

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pairs = [ask(m) for m in frame["prompt"]]
            for place, name in enumerate((column, error)):
                if name:
                    values = [p[place] for p in pairs]
                    frame = frame.assign(**{name: pd.Series(values, index=frame.index, dtype=object)})
            yield frame

    return prompts.mapInPandas(batches, schema)


def _ask(scorer: BatchScorer, batch: int, retry_on: tuple[type[Exception], ...]):
    """Asks in lists of at most ``batch`` chats; a list that fails in passing gets the failure as its error."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                chats = [[(m["role"], m["content"]) for m in messages] for messages in part["prompt"]]
                answers, failure = [None] * len(chats), None
                try:
                    answers = scorer(chats)
                except retry_on as reason:
                    failure = repr(reason)
                if len(answers) != len(chats):
                    raise ValueError(f"{len(answers)} answers to {len(chats)} chats")
                yield pd.DataFrame({"_key": part["_key"], "_answer": answers, "_error": failure}, dtype=object)

    return batches


def score_stored(
    prompts: DataFrame,
    scorer: BatchScorer,
    path: str,
    batch: int = 32,
    in_flight: int = 8,
    wave: int = 100_000,
    rounds: int = 3,
    pause: float = 1.0,
    retry_on: tuple[type[Exception], ...] = PASSING,
    column: str = "pred",
    error: str | None = None,
) -> DataFrame:
    """Add the scorer's answer to every row, from a store of answers that later calls go on with.

    ``path`` is a folder all executors share. Equal prompts are asked once, and prompts that have an
    answer there not at all. The others are asked in waves of about ``wave`` prompts, each stored when it is
    through: a job that is stopped asks again only what its last wave had under way. ``in_flight`` tasks ask at a
    time, ``batch`` chats each. Failures of ``retry_on`` are asked again in the next of ``rounds``, after a
    ``pause`` on the driver that holds no task, and end in NULL, with the text of the failure in column ``error``;
    others stop the job. A store belongs to one scorer.
    """
    spark = prompts.sparkSession
    keyed = prompts.withColumn("_key", F.sha2(F.to_json(F.struct("prompt")), 256))
    asked = checkpoint(keyed.select("_key", "prompt").dropDuplicates(["_key"]))

    def stored() -> DataFrame:
        spark.createDataFrame([], ANSWERS).coalesce(1).write.mode("ignore").parquet(path)
        return spark.read.schema(ANSWERS).parquet(path)

    for turn in range(rounds):
        left = checkpoint(asked.join(stored().where("_error is null"), "_key", "left_anti"))
        many = left.count()
        if not many:
            break
        if turn:
            time.sleep(pause)
        waves = -(-many // wave)
        for k in range(waves):
            part = left.where(F.pmod(F.xxhash64("_key"), F.lit(waves)) == k)
            part.repartition(in_flight).mapInPandas(_ask(scorer, batch, retry_on), ANSWERS).write.mode("append").parquet(path)
    # An answer counts more than a failure that came before it.
    known = stored().groupBy("_key").agg(
        F.count_if(F.col("_error").isNull()).alias("_ok"), F.min("_answer").alias("_answer"), F.max("_error").alias("_error")
    )
    known = checkpoint(known.select("_key", "_answer", F.when(F.col("_ok") == 0, F.col("_error")).alias("_error")))
    rows = lookup_join(keyed, known, "_key", row_key=[c for c in prompts.columns if c != "prompt"])
    added = [F.col("_answer").alias(column), *([F.col("_error").alias(error)] if error else [])]
    return rows.select(*prompts.columns, *added)
