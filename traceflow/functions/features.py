"""Numeric inputs of sequence classifiers."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def truncate_steps(
    sequences: DataFrame, seq_len: int, lists: list[str], short: str = "error"
) -> DataFrame:
    """Cut the lists to their first ``seq_len`` steps; shorter ones are an error."""
    enough = F.size(lists[0]) >= seq_len
    if short == "drop":
        sequences = sequences.where(enough)
    elif short != "error":
        raise ValueError("short must be 'error' or 'drop'")
    cut = {
        name: F.when(F.size(name) >= seq_len, F.slice(name, 1, seq_len)).otherwise(
            F.raise_error(F.lit(f"sequence shorter than {seq_len} steps"))
        )
        for name in lists
    }
    return sequences.withColumns(cut)


def step_matrix(with_kc: bool = False) -> Column:
    """One row per step: difficulty, topic if asked for, answer.

    The answer of the last step is the label, so its place holds 0.
    """
    last = F.size("answers") - 1

    def row(difficulty: Column, i: Column) -> Column:
        answer = F.when(i < last, F.get("answers", i)).otherwise(F.lit(0))
        parts = [difficulty, F.get("kc_ids", i), answer] if with_kc else [difficulty, answer]
        return F.array(*[p.cast("double") for p in parts])

    return F.transform("difficulties", row)


def model_inputs(
    sequences: DataFrame,
    seq_len: int | None = None,
    with_kc: bool = False,
    missing: str = "error",
) -> DataFrame:
    """Add ``features`` (matrix), ``vector`` (flat) and ``label``.

    A sequence with a missing answer or difficulty raises an error or, with
    ``missing="drop"``, is left out.
    """
    lists = ["difficulties", "answers"] + (["kc_ids"] if with_kc else [])
    if seq_len is not None:
        sequences = truncate_steps(sequences, seq_len, lists)
    holes = F.lit(False)
    for name in lists:
        holes = holes | F.exists(name, lambda v: v.isNull())
    features = step_matrix(with_kc)
    if missing == "drop":
        sequences = sequences.where(~holes)
    elif missing == "error":
        features = F.when(holes, F.raise_error(F.lit("missing value in a sequence"))).otherwise(
            features
        )
    else:
        raise ValueError("missing must be 'error' or 'drop'")
    return (
        sequences.withColumn("features", features)
        .withColumn("vector", array_to_vector(F.flatten("features")))
        .withColumn("label", F.try_element_at("answers", F.lit(-1)).cast("int"))
    )
