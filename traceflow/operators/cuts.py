"""Where a position falls in a total order, without sorting the rows.

Each key of the order is read as a row of numbers that order the same way. Counts
per range of the first number tell in which range the position falls; that range is cut again, and when it is
down to one number the next number goes on, until few rows are left in doubt. A round is one scan
of the keys that hands at most ``BINS`` counts to the driver; no row moves.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS = 4096
# Rows left in doubt at most, if the keys can tell more apart.
FEW_ROWS = 100_000
# Bytes of a text that make one number.
_TEXT_BYTES = 6
# Rounds on one number; a range of longs needs six, of doubles with far exponents more.
_ROUNDS = 40

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)
_TIMES = (T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class Cut:
    """Rows before the position for certain, rows in doubt, and how many come before those."""

    before: Column
    doubt: Column
    n_before: int
    n_doubt: int


def _text_number(data: Column, at: int) -> Column:
    """Bytes ``at`` and on of a text as a number; an end counts less than any byte."""
    part = F.substring(data, at + 1, _TEXT_BYTES)
    # Two hex digits a byte and the length, so that a text comes before those it starts.
    number = F.conv(F.rpad(F.hex(part), 2 * _TEXT_BYTES, "0"), 16, 10).cast("long")
    return number * (_TEXT_BYTES + 1) + F.octet_length(part)


def _numbers(rows: DataFrame, name: str) -> list[Column] | None:
    """Numbers that order as the column does, missing values first; None if there are none."""
    kind, value = rows.schema[name].dataType, F.col(name)
    missing = value.isNotNull().cast("int")
    if isinstance(kind, _WHOLE):
        return [missing, value.cast("long")]
    if isinstance(kind, T.DateType):
        return [missing, F.unix_date(value)]
    if isinstance(kind, _TIMES):
        return [missing, F.unix_micros(value.cast("timestamp"))]
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        odd = F.isnan(value) | (F.abs(value) == float("inf"))
        side = F.when(F.isnan(value), 2).when(odd, F.signum(value).cast("int")).otherwise(0)
        return [missing, side, F.when(odd, 0.0).otherwise(value.cast("double"))]
    if isinstance(kind, T.DecimalType):
        whole = F.floor(value)
        return [missing, whole.cast("double"), value.cast("double")]
    if isinstance(kind, (T.StringType, T.BinaryType)):
        data = value.cast("binary")
        longest = rows.agg(F.max(F.octet_length(data))).first()[0] or 0
        return [missing, *[_text_number(data, at) for at in range(0, longest, _TEXT_BYTES)]]
    return None


def _collated(kind: T.DataType) -> bool:
    return isinstance(kind, T.StringType) and not kind.isUTF8BinaryCollation()


def cut(rows: DataFrame, order: Sequence[str], position: int, few: int = FEW_ROWS) -> Cut:
    """The rows before ``position`` in ascending order, up to some in doubt.

    ``order`` names columns; missing values come first, as Spark sorts them. Rows in doubt are at most ``few``, or equal in all
    keys that have numbers: texts by their bytes, numbers, times and flags. From the first other key on, such as a list, rows stay in doubt.
    """
    same, before = F.lit(True), F.lit(False)
    n_before, n_same = 0, rows.count()
    if position <= 0:
        return Cut(before, before, 0, 0)
    if position >= n_same:
        return Cut(same, before, n_same, 0)
    for name in order:
        numbers = None if _collated(rows.schema[name].dataType) else _numbers(rows, name)
        if numbers is None:
            break
        for number in numbers:
            if n_same <= few:
                return Cut(before, same, n_before, n_same)
            number = F.coalesce(number.cast("double") if _is_double(rows, number) else number.cast("long"), F.lit(0))
            below, same, less, n_same = _narrow(rows, same, number, position - n_before, n_same, few)
            before, n_before = before | below, n_before + less
    return Cut(before, same, n_before, n_same)


def _is_double(rows: DataFrame, number: Column) -> bool:
    return isinstance(rows.select(number.alias("n")).schema["n"].dataType, T.DoubleType)


def _narrow(
    rows: DataFrame, same: Column, number: Column, position: int, n_same: int, few: int
) -> tuple[Column, Column, int, int]:
    """Among the rows ``same``: those below the position, those in its range, and both counts."""
    below, less = F.lit(False), 0
    for _ in range(_ROUNDS):
        ends = rows.where(same).agg(F.min(number).alias("low"), F.max(number).alias("high")).first()
        low, high = ends["low"], ends["high"]
        if low == high or n_same <= few:
            break
        width = (high - low) / BINS if isinstance(low, float) else -(-(high - low + 1) // BINS)
        if not width or width == float("inf"):
            break
        bin_no = _bin(number, low, width)
        counts = dict(rows.where(same).groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect())
        passed, chosen = 0, None
        for k in sorted(counts):
            if passed + counts[k] > position - less:
                chosen = k
                break
            passed += counts[k]
        below = below | (same & (bin_no < chosen))
        same = same & (bin_no == chosen)
        less, n_same = less + passed, counts[chosen]
    return below, same, less, n_same


def _bin(number: Column, low: float | int, width: float | int) -> Column:
    """The range of a number, counted from zero; in whole numbers if it is one."""
    if isinstance(low, float):
        return F.least(F.floor((number - F.lit(low)) / F.lit(width)).cast("long"), F.lit(BINS - 1))
    if low + width * BINS < 1 << 62 and low > -(1 << 62):
        off = number - F.lit(low)
        return F.call_function("div", off, F.lit(width))
    # Differences of such longs can exceed a long.
    return F.floor((number.cast("decimal(20,0)") - F.lit(low)) / F.lit(width)).cast("long")
