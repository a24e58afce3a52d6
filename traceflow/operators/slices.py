"""Leading slices and ranges of positions under an explicit order."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceflow.operators.cuts import cut
from traceflow.operators.ranking import ordered_positions

# Up to here a slice is a top-k; beyond it positions come from a range sort.
TOP_ROWS = 10_000


def _total_order(rows: DataFrame, order: Sequence[str]) -> list[str]:
    """The given keys and then every other column that has an order."""
    rest = [f.name for f in rows.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    return [*order, *[c for c in rest if c not in order]]


def position_slice(
    rows: DataFrame, order: Sequence[str], start: int, stop: int, top_rows: int = TOP_ROWS
) -> DataFrame:
    """Rows at positions ``start .. stop - 1`` in the given order, with ``pos``.

    Rows with equal keys are ordered by their other columns, so both paths agree. Beyond
    ``top_rows`` the two ends are found by ``cut``, and only the rows between them are sorted and written.
    """
    names = _total_order(rows, order)
    keys = [F.col(c) for c in names]
    if stop <= top_rows:
        numbered = (
            rows.orderBy(*keys)
            .limit(stop)
            .withColumn("pos", F.row_number().over(Window.orderBy(*keys)).cast("long") - 1)
        )
    else:
        first, last = cut(rows, names, start, max(1, top_rows)), cut(rows, names, stop, max(1, top_rows))
        between = rows.where(~first.before & (last.before | last.doubt))
        numbered = ordered_positions(between, [k.asc() for k in keys]).withColumn("pos", F.col("pos") + first.n_before)
    return numbered.where((F.col("pos") >= start) & (F.col("pos") < stop))


def leading_slice(
    rows: DataFrame,
    order: Sequence[str],
    count: int | None = None,
    compat: bool = False,
    top_rows: int = TOP_ROWS,
) -> DataFrame:
    """The first ``count`` rows in the given total order; None keeps all.

    A negative count is refused, or with ``compat`` drops that many rows from
    the end, as a Python slice does.
    """
    if count is None:
        return rows
    if count < 0:
        if not compat:
            raise ValueError("a negative count needs compat=True")
        count = max(0, rows.count() + count)
    if count <= top_rows:
        return position_slice(rows, order, 0, count, top_rows).drop("pos")
    # No position is asked for, so only the rows in doubt are sorted.
    names = _total_order(rows, order)
    end = cut(rows, names, count, max(1, top_rows))
    doubt = rows.where(end.doubt)
    if end.n_doubt <= top_rows:
        doubt = doubt.orderBy(*names).limit(count - end.n_before)
    else:
        placed = ordered_positions(doubt, [F.col(c).asc() for c in names])
        doubt = placed.where(F.col("pos") < count - end.n_before).drop("pos")
    return rows.where(end.before).unionByName(doubt)
