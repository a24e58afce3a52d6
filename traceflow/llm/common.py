"""Helpers shared by the operators: written intermediate tables and column care."""

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceflow.session import shared_folder

# Removes the shuffle files of a finished write, which nothing reads again.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def new_folder(spark: SparkSession) -> str:
    """The name of a new folder that all executors share."""
    return f"{shared_folder(spark)}/traceflow-{uuid.uuid4().hex}"


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files.

    Cuts the lineage: a lost executor costs a read of these files, not the work
    before them. Every call takes a folder of its own.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    with _setting(spark, _CLEANUP, "true"):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def store_bucketed(df: DataFrame, key: str, files: int) -> DataFrame:
    """Like ``store``, as a table of ``files`` buckets by ``key``.

    Joins on the key with small tables then move the other side only.
    """
    spark = df.sparkSession
    name = f"traceflow_{uuid.uuid4().hex}"
    with _setting(spark, _CLEANUP, "true"):
        (
            df.write.option("compression", "zstd")
            .option("path", new_folder(spark))
            .bucketBy(files, key)
            .saveAsTable(name)
        )
    return spark.table(name)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8(name: str) -> Column:
    """A text column as UTF-8 bytes, null as null."""
    return F.col(name).cast("string").cast("binary")
