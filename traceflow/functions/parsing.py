"""Flags, tolerant integers and the word form of an answer."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The two answer words.
CORRECT = "CORRECT"
WRONG = "WRONG"

# Digits may be grouped by single underscores.
_GROUPED = r"^\s*[+-]?[0-9]+(_[0-9]+)+\s*$"

PADDING = -1


def _column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def flag(value: str | Column) -> Column:
    """True and false as words, booleans or the numbers 1 and 0; anything else -> NULL."""
    value = _column(value)
    text = F.lower(value.cast("string"))
    number = (F.typeof(value) != "string") & text.isin("1", "1.0", "0", "0.0")
    return (
        F.when(text == "true", 1)
        .when(text == "false", 0)
        .when(number, text.startswith("1").cast("int"))
    )


def tolerant_int(value: str | Column) -> Column:
    """Whole number of a text or number, -1 where there is none."""
    value = _column(value)
    text = value.cast("string")
    grouped = F.when(text.rlike(_GROUPED), F.replace(text, F.lit("_"), F.lit("")))
    return F.coalesce(grouped.try_cast("bigint"), value.try_cast("bigint"), F.lit(PADDING)).cast(
        "bigint"
    )


def tolerant_ints(values: str | Column) -> Column:
    return F.transform(_column(values), tolerant_int)


def is_padded(values: str | Column) -> Column:
    """Whether a list of answers holds the padding value."""
    return F.array_contains(_column(values).cast("array<bigint>"), F.lit(PADDING).cast("bigint"))


def last(values: str | Column) -> Column:
    return F.try_element_at(_column(values), F.lit(-1))


def answer_word(answer: str | Column) -> Column:
    """The word of an answer; a missing answer has none."""
    return F.when(_column(answer) == 1, F.lit(CORRECT)).when(_column(answer).isNotNull(), F.lit(WRONG))


def without_missing(rows: DataFrame, lists: Sequence[str], missing: str = "error") -> DataFrame:
    """Refuse or leave out rows with a missing value in one of ``lists``."""
    holes = F.lit(False)
    for name in lists:
        holes = holes | F.exists(name, lambda v: v.isNull())
    if missing == "drop":
        return rows.where(~holes)
    if missing != "error":
        raise ValueError("missing must be 'error' or 'drop'")
    message = F.raise_error(F.lit(f"missing value in {', '.join(lists)}"))
    return rows.withColumn(lists[0], F.when(holes, message).otherwise(F.col(lists[0])))


def word_flag(word: str | Column) -> Column:
    """1 for exactly the word CORRECT, 0 for every other text."""
    return F.coalesce((_column(word) == CORRECT).cast("int"), F.lit(0))


def threshold(score: str | Column, cut: float = 0.5) -> Column:
    return (_column(score) >= F.lit(cut)).cast("double")


def verdict(label: str | Column, pred: str | Column, conf: str | Column) -> Column:
    """Whether the raw score of a prediction was fitting."""
    label, pred, conf = _column(label), _column(pred), _column(conf)
    return (
        F.when((label != pred) & (conf > 0.9), F.lit("Overconfident"))
        .when((label == pred) & (conf < 0.1), F.lit("Underconfident"))
        .otherwise(F.lit("Balanced"))
    )
