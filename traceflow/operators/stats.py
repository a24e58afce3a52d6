"""Counts and ratios of attempt logs and sequences."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceflow.functions.parsing import last


def count_students(attempts: DataFrame) -> DataFrame:
    return attempts.agg(F.count_distinct("student_id").alias("students"))


def questions_per_student(attempts: DataFrame) -> DataFrame:
    return (
        attempts.where(F.col("student_id").isNotNull())
        .groupBy("student_id")
        .agg(F.count(F.lit(1)).alias("num_questions"))
    )


def split_sizes(rows: DataFrame, split: str = "split") -> DataFrame:
    """Rows per split and, as split ``all``, in total."""
    return (
        rows.rollup(split)
        .agg(F.count(F.lit(1)).alias("sequences"), F.grouping_id().alias("_level"))
        .select(
            F.when(F.col("_level") == 1, F.lit("all")).otherwise(F.col(split)).alias(split),
            "sequences",
        )
    )


def correct_ratio(sequences: DataFrame) -> DataFrame:
    """Share of sequences whose last answer is correct; NULL for no sequence."""
    right = F.count_if(last("answers") == 1)
    rows = F.count(F.lit(1))
    return sequences.agg(
        rows.alias("sequences"),
        right.alias("correct"),
        F.try_divide(right.cast("double"), rows.cast("double")).alias("correct_ratio"),
    )


def union_all(*parts: DataFrame) -> DataFrame:
    """All rows of all parts, duplicates kept."""
    return reduce(DataFrame.unionByName, parts)


def preview(rows: DataFrame, count: int = 5) -> DataFrame:
    return rows.limit(count)
