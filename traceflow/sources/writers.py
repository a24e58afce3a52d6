"""Writers of tables, sequences, metrics and training text."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceflow.operators.prompts import END_OF_TEXT, training_lines
from traceflow.operators.sampling import shuffled
from traceflow.operators.selection import METRICS, best_run
from traceflow.operators.splits import expand_folds


def write_csv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; quotes inside fields are doubled."""
    rows.write.mode(mode).csv(path, header=True, escape='"')


def write_sequences(
    labelled: DataFrame,
    path: str,
    folds: int = 3,
    fmt: str = "parquet",
    mode: str = "errorifexists",
) -> None:
    """All splits of all folds and lengths in one job, one directory each.

    Rows are rebalanced by directory first, so that a directory gets few files
    of a good size however many tasks there are; large ones are split.
    """
    directories = ["n", "split", "fold"]
    expand_folds(labelled, folds).drop("block").hint("rebalance", *directories).write.mode(
        mode
    ).partitionBy(*directories).format(fmt).save(path)


def write_blocks(labelled: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Every sequence once, one directory per length and block; ``readers.read_fold`` sees any fold in them.

    The files of ``write_sequences`` hold a sequence once per fold it takes part in, these a
    third of that for three folds. A sequence without a block belongs to no split and is refused.
    """
    block = F.coalesce("block", F.raise_error(F.lit("a sequence has no block")).cast("string"))
    rows = labelled.withColumn("block", block).hint("rebalance", "n", "block")
    rows.write.mode(mode).partitionBy("n", "block").format(fmt).save(path)


def write_metrics(log: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """All runs and the best run per model and split, as JSON under ``path``."""
    log.write.mode(mode).partitionBy("split").json(f"{path}/all")
    best_run(log, ["model", "n", "layers", "split"]).select(
        "model", "n", "layers", "epoch", *METRICS, "split"
    ).write.mode(mode).partitionBy("split").json(f"{path}/best")


def training_text(sequences: DataFrame) -> DataFrame:
    """Add ``value``: the training line followed by the end mark on its own line."""
    return training_lines(sequences).withColumn(
        "value", F.concat("line", F.lit(f"\n{END_OF_TEXT}"))
    )


def write_training_text(
    sequences: DataFrame, path: str, seed: int = 1, mode: str = "errorifexists"
) -> None:
    """Training text in seeded shuffled order; part files are in that order."""
    shuffled(training_text(sequences), ["student_id", "n", "chunk"], seed).select(
        "value"
    ).write.mode(mode).text(path)


def json_records(rows: DataFrame, column: str = "record") -> DataFrame:
    """Every row as one JSON text."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias(column))
