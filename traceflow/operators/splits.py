"""Leakage-free splits: whole students go to the hold-out or to one fold."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceflow.operators.joins import salted_join
from traceflow.operators.ranking import hash_positions

TEST = "test"


def distinct_students(attempts: DataFrame) -> DataFrame:
    return attempts.select("student_id").where(F.col("student_id").isNotNull()).distinct()


def fold_of(position: Column, count: Column, folds: int) -> Column:
    """Fold of a position when ``count`` rows are cut into contiguous blocks.

    The first ``count % folds`` blocks hold one row more than the others.
    """
    size = F.greatest(F.floor(count / F.lit(folds)).cast("long"), F.lit(1))
    longer = F.pmod(count, F.lit(folds))
    head = longer * (size + 1)
    return (
        F.when(count < folds, position)
        .when(position < head, F.floor(position / (size + 1)))
        .otherwise(longer + F.floor((position - head) / size))
        .cast("int")
    )


def student_split(
    attempts: DataFrame, seed: int = 42, train_share: float = 0.85, folds: int = 3
) -> DataFrame:
    """``student_id, pos, block``: block is ``test`` or the fold number 0, 1, …

    Students are put in seeded hash order; the last ``1 - train_share`` of them
    are the hold-out and the rest are cut into contiguous folds.
    """
    ranked = hash_positions(distinct_students(attempts), ["student_id"], seed, total="_students")
    kept = F.floor(F.lit(float(train_share)) * F.col("_students")).cast("long")
    block = F.when(F.col("pos") >= kept, F.lit(TEST)).otherwise(
        fold_of(F.col("pos"), kept, folds).cast("string")
    )
    return ranked.select("student_id", "pos", block.alias("block"))


def in_test(block: str = "block") -> Column:
    return F.col(block) == TEST


def in_validation(fold: int, block: str = "block") -> Column:
    """Rows of validation fold ``fold``, counted from 1."""
    return F.col(block) == str(fold - 1)


def in_training(fold: int, block: str = "block") -> Column:
    """Rows outside validation fold ``fold`` and outside the hold-out."""
    return ~F.col(block).isin(str(fold - 1), TEST)


def split_name(fold: int, block: str = "block") -> Column:
    """``train``, ``val`` or ``test`` of a block seen from one fold."""
    return (
        F.when(in_test(block), F.lit("test"))
        .when(in_validation(fold, block), F.lit("val"))
        .otherwise(F.lit("train"))
    )


def expand_folds(labelled: DataFrame, folds: int = 3) -> DataFrame:
    """One copy of a row per fold it takes part in, with ``split`` and ``fold``.

    Hold-out rows appear once, with fold 0.
    """
    members = F.when(
        in_test(), F.array(F.struct(F.lit("test").alias("split"), F.lit(0).alias("fold")))
    ).otherwise(
        F.array(
            *[
                F.struct(split_name(f).alias("split"), F.lit(f).alias("fold"))
                for f in range(1, folds + 1)
            ]
        )
    )
    return labelled.select("*", F.explode(members).alias("_member")).select(
        *labelled.columns, "_member.split", "_member.fold"
    )


def attach_split(
    rows: DataFrame, split: DataFrame, row_key: list[str] | None = None
) -> DataFrame:
    """Keep rows of students in the split and add their block."""
    return salted_join(
        rows, split.select("student_id", "block"), "student_id", "inner", row_key or ()
    )
