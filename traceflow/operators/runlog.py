"""A log of runs that a job can go on with after it was stopped.

The rows of a finished run are one Parquet file, which Spark's committer moves into the log at
once: a run is there as a whole or not at all. A job asks which runs are there and does the others.
"""

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class RunLog:
    """Rows of ``schema`` in the folder ``path``, which all executors share; ``key`` tells runs apart.

    A log belongs to one job with one set of parameters. Should two jobs finish the same run, its equal
    rows are read once.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: Sequence[str]):
        self.spark, self.path, self.schema, self.key = spark, path, schema, list(key)

    def read(self, runs: Iterable[tuple] | None = None) -> DataFrame:
        """All rows, or those of the runs with the given values of the key; an unknown path is an empty log."""
        # An empty file makes the folder known before the first run ends.
        self.spark.createDataFrame([], self.schema).coalesce(1).write.mode("ignore").parquet(self.path)
        rows = self.spark.read.schema(self.schema).parquet(self.path).dropDuplicates()
        if runs is None:
            return rows
        kinds = T.StructType([self.schema[k] for k in self.key])
        asked = self.spark.createDataFrame(list(dict.fromkeys(runs)), kinds)
        return rows.join(F.broadcast(asked), self.key, "left_semi").select(*self.schema.names)

    def finished(self) -> set[tuple]:
        """Keys of the runs in the log; one for each run, not for each row of data."""
        return {tuple(r) for r in self.read().select(*self.key).distinct().collect()}

    def add(self, rows: Iterable[tuple]) -> None:
        """Add the rows of one run."""
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.mode("append").parquet(self.path)
