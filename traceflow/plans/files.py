"""Registered queries that write the tables as files and read those back."""

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceflow.operators import history, lookups, selection, splits
from traceflow.operators.prompts import END_OF_TEXT
from traceflow.plans import catalog
from traceflow.session import shared_folder
from traceflow.sources import ranges, readers, writers
from traceflow.sources import testtables as tt

Query = Callable[[SparkSession, str], DataFrame]

# Sequences of one JSON array.
FILE_ROWS = 500


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/traceflow-{uuid.uuid4().hex}"


def _written(spark: SparkSession, rows: DataFrame) -> str:
    path = _folder(spark)
    writers.write_csv(rows, path)
    return path


def _spread(text: str) -> Column:
    """A text with a line break, a comma and quotes around it."""
    return F.concat(F.lit('say "'), F.col(text), F.lit('",\n'), F.col(text))


def documents_from_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents, with the line breaks and quotes they have, through CSV."""
    docs = tt.table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    read = ranges.read_quoted_csv(spark, _written(spark, docs))
    return read.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.md5("text").alias("text_md5"),
        "lang",
        "source",
        F.col("n_chars").cast("long").alias("n_chars"),
    )


def attempts_from_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The attempt log, with a column that spans lines, through CSV."""
    log = tt.attempts(spark, sf).select(
        F.col("seq").alias("id"),
        F.concat(F.lit('a "note",\nof '), F.col("seq")).alias("note"),
        "student_id",
        "question_id",
        F.when(F.col("answer") == 1, "True").otherwise("False").alias("answer_state"),
        F.when(F.col("hint") == 1, "true").otherwise("false").alias("hint_used"),
        F.date_format("start_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start_time"),
    )
    read = readers.read_attempts(spark, _written(spark, log), multi_line=True)
    return read.withColumn("start_time", F.unix_micros("start_time"))


def questions_from_csv(spark: SparkSession, sf: str) -> DataFrame:
    found = tt.questions(spark, sf).withColumn("question_rich_text", _spread("question_rich_text"))
    return readers.read_questions(spark, _written(spark, found))


def kcs_from_csv(spark: SparkSession, sf: str) -> DataFrame:
    return readers.read_kcs(spark, _written(spark, tt.kcs(spark, sf).withColumn("description", _spread("name"))))


def question_kc_from_csv(spark: SparkSession, sf: str) -> DataFrame:
    relation = tt.question_kc(spark, sf).withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return readers.read_question_kc(spark, _written(spark, relation.drop(*tt.KC_ORDER)))


def kc_link_from_csv(spark: SparkSession, sf: str) -> DataFrame:
    topics = tt.kcs(spark, sf).withColumn("description", _spread("name"))
    link = lookups.kc_link(tt.question_kc(spark, sf).drop(*tt.KC_ORDER), topics)
    return readers.read_kc_link(spark, _written(spark, link))


def sequence_files(spark: SparkSession, sf: str) -> DataFrame:
    """Sequences as files of one JSON array each, and read back from byte ranges of them."""
    found = history.sequences(tt.attempts(spark, sf), tt.questions(spark, sf), (5,))
    lists = ["question_ids", "answers", "difficulties", "hint_used"]
    record = F.to_json(F.struct("student_id", *lists))
    arrays = (
        found.select(record.alias("record"), F.floor(F.monotonically_increasing_id() / FILE_ROWS).alias("file"))
        .groupBy("file")
        .agg(F.collect_list("record").alias("records"))
        .select(F.concat(F.lit("["), F.array_join("records", ", "), F.lit("]")).alias("value"))
    )
    path = _folder(spark)
    arrays.write.text(path)
    read = readers.read_sequence_file(spark, path)
    texts = [F.array_join(F.col(c).cast("array<string>"), ",", "?").alias(c) for c in lists]
    return read.select("student_id", "n", *texts)


def sequences_of_fold(spark: SparkSession, sf: str) -> DataFrame:
    """The validation sequences of one fold and length, from the directories that hold them."""
    log = tt.attempts(spark, sf)
    labelled = history.sequences(log, tt.questions(spark, sf), (5, 10), splits.student_split(log))
    path = _folder(spark)
    writers.write_sequences(labelled, path)
    return readers.read_sequences(spark, path, n=5, split="val", fold=2).select(
        "student_id", "chunk", F.array_join(F.col("answers").cast("array<string>"), ",").alias("answers"), "n", "split", "fold"
    )


def sequences_of_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """All splits of one fold and the validation split of another, from files that hold every sequence once."""
    log = tt.attempts(spark, sf)
    path = _folder(spark)
    writers.write_blocks(history.sequences(log, tt.questions(spark, sf), (5, 10), splits.student_split(log)), path)
    seen = readers.read_fold(spark, path, 1).unionByName(readers.read_fold(spark, path, 3, "val", 10))
    return seen.select(
        "student_id", "chunk", F.array_join(F.col("answers").cast("array<string>"), ",").alias("answers"), "n", "split", "fold"
    )


def metrics_files(spark: SparkSession, sf: str) -> DataFrame:
    """The best run per configuration and split, from the files of a metric log."""
    path = _folder(spark)
    writers.write_metrics(catalog.metric_log(spark, sf), path)
    schema = "model string, n int, layers int, epoch int, " + ", ".join(
        f"{m} {'long' if m.startswith('sup') else 'double'}" for m in selection.METRICS
    )
    return spark.read.schema(f"{schema}, split string").json(f"{path}/best")


def training_text_file(spark: SparkSession, sf: str) -> DataFrame:
    """The records of the training text with how often each occurs."""
    found = history.sequences(tt.attempts(spark, sf), tt.questions(spark, sf), (5,))
    path = _folder(spark)
    writers.write_training_text(found, path)
    read = spark.read.option("lineSep", f"\n{END_OF_TEXT}\n").text(path)
    return read.groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("times"))


def queries() -> dict[str, Query]:
    found = (
        documents_from_csv,
        attempts_from_csv,
        questions_from_csv,
        kcs_from_csv,
        question_kc_from_csv,
        kc_link_from_csv,
        sequence_files,
        sequences_of_fold,
        sequences_of_blocks,
        metrics_files,
        training_text_file,
    )
    return {f.__name__: f for f in found}
