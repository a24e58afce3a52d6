"""Question topics (knowledge components) and step-level enrichment."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceflow.functions.text import strip
from traceflow.operators.history import first_per_key
from traceflow.operators.joins import lookup_join
from traceflow.schemas import SEQUENCE_KEY


def kc_link(question_kc: DataFrame, kcs: DataFrame, **join_options) -> DataFrame:
    """Question–topic relation with the topic's name and description.

    Relation rows of unknown topics are dropped; a topic id that occurs twice
    is an error.
    """
    topics = kcs.groupBy(F.col("id").alias("kc_id")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("name").alias("name"),
        F.min("description").alias("description"),
    )
    message = F.concat(F.lit("duplicate topic id "), F.col("kc_id").cast("string"))
    topics = topics.select(
        F.when(F.col("_n") == 1, F.col("kc_id")).otherwise(F.raise_error(message)).alias("kc_id"),
        "name",
        "description",
    )
    relation = question_kc.withColumnRenamed("knowledgecomponent_id", "kc_id")
    joined = lookup_join(
        # One row per topic of the table, which is cheaper to measure.
        relation, topics, "kc_id", "inner", row_key=relation.columns, bound=kcs, **join_options
    )
    kept = [c for c in relation.columns if c not in ("question_id", "kc_id")]
    return joined.select("question_id", "kc_id", "name", "description", *kept)


def one_kc(
    question_kc: DataFrame,
    rule: str,
    order: Sequence[str] = ("id",),
    kc: str = "knowledgecomponent_id",
) -> DataFrame:
    """One topic per question: the ``first`` or the ``last`` relation row.

    ``order`` must tell all rows of a question apart. A single number as order
    key keeps the aggregate hash based.
    """
    pick = {"first": F.min_by, "last": F.max_by}[rule]
    place = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    return question_kc.groupBy("question_id").agg(pick(kc, place).cast("long").alias("kc_id"))


def _keys(sequences: DataFrame) -> list[str]:
    """The columns that identify a sequence, and its block or split if it has one."""
    missing = [c for c in SEQUENCE_KEY if c not in sequences.columns]
    if missing:
        raise ValueError(f"sequences need the columns {', '.join(missing)}")
    return [c for c in (*SEQUENCE_KEY, "block", "split", "fold") if c in sequences.columns]


def explode_steps(sequences: DataFrame) -> DataFrame:
    """One row per step with its position; sequence columns are repeated."""
    lists = ["question_ids", "answers", "difficulties", "hint_used"]
    keys = [c for c in sequences.columns if c not in lists]
    return sequences.select(*keys, F.posexplode(F.arrays_zip(*lists)).alias("pos", "_step")).select(
        *keys,
        "pos",
        F.col("_step.question_ids").alias("question_id"),
        F.col("_step.answers").alias("answer"),
        F.col("_step.difficulties").alias("difficulty"),
        F.col("_step.hint_used").alias("hint"),
    )


def with_kc(
    sequences: DataFrame, question_kc_one: DataFrame, unknown: str = "error", **join_options
) -> DataFrame:
    """Add ``kc_ids``, the topic of every step."""
    keys = _keys(sequences)
    steps = lookup_join(
        explode_steps(sequences),
        question_kc_one.select("question_id", "kc_id"),
        "question_id",
        "left",
        row_key=("student_id", "n", "chunk", "pos"),
        **join_options,
    )
    step = F.struct("pos", "question_id", "answer", "difficulty", "hint", "kc_id")
    grouped = steps.groupBy(*keys).agg(
        F.sort_array(F.collect_list(step)).alias("_steps"),
        F.bool_or(F.col("kc_id").isNull()).alias("_missing"),
    )
    kc_ids = F.col("_steps.kc_id")
    if unknown == "error":
        message = F.raise_error(F.lit("question without a topic"))
        kc_ids = F.when(F.col("_missing"), message).otherwise(kc_ids)
    elif unknown == "drop":
        grouped = grouped.where(~F.col("_missing"))
    else:
        raise ValueError("unknown must be 'error' or 'drop'")
    return grouped.select(
        *keys,
        F.col("_steps.question_id").alias("question_ids"),
        F.col("_steps.answer").alias("answers"),
        F.col("_steps.difficulty").alias("difficulties"),
        F.col("_steps.hint").alias("hint_used"),
        kc_ids.alias("kc_ids"),
    )


def enrich_steps(
    sequences: DataFrame,
    questions: DataFrame,
    question_kc_one: DataFrame,
    order: Sequence[str] = (),
    **join_options,
) -> DataFrame:
    """Question text, topic and current difficulty for every step.

    Steps of questions missing from ``questions`` are left out of all lists
    alike, so the lists stay aligned; a sequence that knows none of its questions keeps
    empty lists. A question that occurs twice counts with its first row in ``order``. A known question without a topic is an
    error. Text and topic are stripped of surrounding white space.
    """
    source = questions.select(*dict.fromkeys(["id", "question_rich_text", "difficulty", *order]))
    texts = first_per_key(source, "id", order).select(
        F.col("id").alias("question_id"), "question_rich_text", "difficulty"
    )
    topics = question_kc_one.select("question_id", F.col("kc_id").cast("string").alias("_kc"))
    table = texts.join(topics, "question_id", "left").select(
        "question_id",
        strip("question_rich_text").alias("question"),
        "difficulty",
        strip("_kc").alias("kc"),
        F.lit(True).alias("known"),
    )
    keys = _keys(sequences)
    steps = lookup_join(
        explode_steps(sequences).drop("difficulty"),
        table,
        "question_id",
        "left",
        row_key=("student_id", "n", "chunk", "pos"),
        # One row per question, and a topic is no longer than a number.
        bound=source.withColumn("kc", F.lit(" " * 20)),
        **join_options,
    )
    topic = F.coalesce(F.col("kc"), F.raise_error(F.lit("question without a topic")))
    step = F.when(
        F.col("known"),
        F.struct("pos", "question_id", "question", topic.alias("kc"), "difficulty", "answer"),
    )
    grouped = steps.groupBy(*keys).agg(F.sort_array(F.collect_list(step)).alias("_steps"))
    return grouped.select(
        *keys,
        F.col("_steps.question_id").alias("question_ids"),
        F.col("_steps.question").alias("questions"),
        F.col("_steps.kc").alias("kcs"),
        F.col("_steps.difficulty").alias("difficulties"),
        F.col("_steps.answer").alias("answers"),
    )
