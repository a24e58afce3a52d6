"""Best runs and best configurations from a log of metrics."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ["acc", "bal_acc", "f1_0", "f1_1", "sup_0", "sup_1", "auc"]


def best_run(log: DataFrame, by: Sequence[str], metric: str = "bal_acc") -> DataFrame:
    """The row with the highest metric per group; the earliest epoch wins ties.

    A run whose metric is 0 or missing never wins, so a group may have no row.
    """
    others = [c for c in log.columns if c not in by]
    best = F.max_by(F.struct(*others), F.struct(F.col(metric), -F.col("epoch"))).alias("_best")
    return (
        log.where(F.col(metric) > 0)
        .groupBy(*by)
        .agg(best)
        .select(*by, *[F.col("_best")[c].alias(c) for c in others])
    )


def best_config(log: DataFrame, metric: str = "bal_acc", test_at: str = "test") -> DataFrame:
    """Per model family the configuration with the best validation metric.

    Each configuration is represented by its best validation epoch, and the
    first configuration of the grid wins ties. Its test record is the one with
    the best test metric (``test_at="test"``) or the one of the same epoch
    (``test_at="val"``).
    """
    config = ["model", "n", "layers", "grid_order"]
    record = F.struct("epoch", *METRICS)

    def winners(split: str) -> DataFrame:
        best = best_run(log.where(F.col("split") == split), config, metric)
        return best.select(*config, record.alias(split))

    val = winners("val")
    if test_at == "test":
        both = val.join(winners("test"), config, "left")
    elif test_at == "val":
        test = log.where(F.col("split") == "test").select(
            *config, F.col("epoch").alias("_epoch"), record.alias("test")
        )
        both = val.withColumn("_epoch", F.col("val.epoch")).join(test, [*config, "_epoch"], "left")
    else:
        raise ValueError("test_at must be 'test' or 'val'")
    choice = F.max_by(
        F.struct("n", "layers", "val", "test"),
        F.struct(F.col(f"val.{metric}"), -F.col("grid_order")),
    )
    return (
        both.groupBy("model")
        .agg(choice.alias("_best"))
        .select("model", "_best.n", "_best.layers", "_best.val", "_best.test")
    )
