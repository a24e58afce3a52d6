"""The test tables seen as attempts, questions, topics and word vectors."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceflow.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attempts: an event of type ``error`` is a wrong answer."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("student_id"),
        F.get_json_object("props", "$.k").cast("long").alias("question_id"),
        (F.col("event_type") != "error").cast("int").alias("answer"),
        (F.col("value") > 100).cast("int").alias("hint"),
        F.col("ts").alias("start_time"),
        F.col("event_id").alias("seq"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        (F.pmod(F.col("p_size"), F.lit(3)) + 1).cast("int").alias("difficulty"),
        F.col("p_name").alias("question_rich_text"),
    )


# Row order of the question–topic relation.
KC_ORDER = ("l_orderkey", "l_linenumber", "l_suppkey")


def question_kc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("question_id"),
        F.col("l_suppkey").alias("knowledgecomponent_id"),
        *KC_ORDER,
    )


def kcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("Topic "), F.col("s_name")).alias("description"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, one file at the small scales, over all cores."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scored binary labels."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        (F.col("l_linestatus") == "O").cast("int").alias("label"),
        (F.col("l_discount") * 10).alias("conf"),
    )
