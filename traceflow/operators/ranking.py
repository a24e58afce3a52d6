"""Global positions and prefix sums without an un-partitioned window."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceflow.session import checkpoint

# Hex digits of a level at most: a window over one level has up to 4096 rows.
HASH_DIGITS = 3
# What an input of unknown size counts as.
UNKNOWN_BYTES = 10**12
# Rows that one bucket is to have at most.
BUCKET_ROWS = 1_000_000
_LOCAL_BITS = 33


def hash_order(seed: int, *keys: str | Column) -> Column:
    """Pseudo-random but reproducible order key of a row."""
    parts = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def levels_for(rows: int, bucket_rows: int = BUCKET_ROWS) -> tuple[int, ...]:
    """Hex digits of each level so that a bucket has about ``bucket_rows`` rows at most."""
    digits = HASH_DIGITS
    while 16**digits * bucket_rows < rows:
        digits += 1
    full, rest = divmod(digits, HASH_DIGITS)
    return (rest,) * bool(rest) + (HASH_DIGITS,) * full


def planned_rows(df: DataFrame) -> int:
    """A guess from above at the rows that ``df`` reads, from the sizes Spark plans with; runs nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(min(size, UNKNOWN_BYTES) for size in sizes) // 8


def running_totals(totals: DataFrame, levels: Sequence[int]) -> DataFrame:
    """Add ``_offset``, the sum of ``_amount`` over all lesser ``_bucket``, and ``_total`` over all.

    A bucket is a text of hex digits, ``levels`` of them per level. Sums of the buckets that share all but the last
    level are scanned first, in the same way, so that no window has more than ``16 ** digits`` rows
    of one level, however many buckets there are.
    """
    shared = sum(levels[:-1])
    parent = F.substring("_bucket", 1, shared) if shared else F.lit("")
    keyed = totals.withColumn("_parent", parent)
    inside = Window.partitionBy("_parent").orderBy("_bucket") if shared else Window.orderBy("_bucket")
    earlier = F.coalesce(F.sum("_amount").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if not shared:
        everything = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return totals.select("_bucket", earlier.alias("_offset"), F.sum("_amount").over(everything).alias("_total"))
    above = keyed.groupBy(F.col("_parent").alias("_bucket")).agg(F.sum("_amount").alias("_amount"))
    above = running_totals(above, levels[:-1]).select(
        F.col("_bucket").alias("_parent"), F.col("_offset").alias("_above"), "_total"
    )
    return (
        keyed.withColumn("_own", earlier)
        .join(above, "_parent")
        .select("_bucket", (F.col("_above") + F.col("_own")).alias("_offset"), "_total")
    )


def hash_positions(
    df: DataFrame,
    keys: Sequence[str],
    seed: int,
    position: str = "pos",
    weight: str | None = None,
    total: str | None = None,
    digits: int | Sequence[int] | None = None,
) -> DataFrame:
    """Zero-based position of every row in seeded hash order.

    With ``weight`` the position is the sum of the weights of all earlier rows.
    ``keys`` must identify a row. Rows are ranked inside buckets given by the
    first digits of the hash, and the bucket totals by ``running_totals``: ``digits`` has the digits
    of its levels, as many as the size of the input asks for if it is None. The rows move once, to their
    bucket, where its offset joins them. Buckets depend on the data alone: recomputing a lost task gives the same.
    """
    if digits is None:
        digits = levels_for(planned_rows(df))
    levels = (digits,) if isinstance(digits, int) else tuple(digits)
    amount = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    hashed = df.withColumn("_hash", hash_order(seed, *keys)).withColumn(
        "_bucket", F.substring("_hash", 1, sum(levels))
    )
    buckets = running_totals(hashed.groupBy("_bucket").agg(F.sum(amount).alias("_amount")), levels)
    inside = Window.partitionBy("_bucket").orderBy("_hash", *keys)
    if weight is None:
        local = F.row_number().over(inside).cast("long") - 1
    else:
        local = F.coalesce(
            F.sum(amount).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        )
    # A single level has few buckets by definition; more join by shuffle, or as Spark measures them.
    placed = F.broadcast(buckets) if len(levels) == 1 and levels[0] <= HASH_DIGITS else buckets
    ranked = hashed.withColumn("_local", local).join(placed, "_bucket")
    columns = [*df.columns, (F.col("_offset") + F.col("_local")).alias(position)]
    if total is not None:
        columns.append(F.col("_total").alias(total))
    return ranked.select(*columns)


def range_sorted(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Sort globally over evenly filled range partitions and keep the result.

    Adds ``_part`` (partition) and ``_index`` (row inside it). The cut points of
    a range exchange are sampled, so the sorted rows are checkpointed once and
    every later step reads the same files. ``order`` must be a total order.
    """
    row = F.col("_row")
    return checkpoint(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_row", F.monotonically_increasing_id())
    ).select(
        *df.columns,
        F.shiftrightunsigned(row, _LOCAL_BITS).alias("_part"),
        row.bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)).alias("_index"),
    )


def group_positions(
    df: DataFrame, group: str, order: Sequence[Column], position: str = "pos"
) -> DataFrame:
    """Position inside each group for few groups that are too big for one task.

    Each group is cut into runs, one per range partition it touches. There are
    fewer runs than partitions plus groups, so the run table is broadcast.
    """
    ordered = range_sorted(df, [F.col(group).asc(), *order])
    earlier = Window.partitionBy(group).orderBy("_part")
    runs = (
        ordered.groupBy(group, "_part")
        .agg(F.min("_index").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .select(
            group,
            "_part",
            "_first",
            F.coalesce(
                F.sum("_rows").over(earlier.rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ).alias("_before"),
        )
    )
    return ordered.join(F.broadcast(runs), [group, "_part"]).select(
        *df.columns,
        (F.col("_before") + F.col("_index") - F.col("_first")).alias(position),
    )


def ordered_positions(df: DataFrame, order: Sequence[Column], position: str = "pos") -> DataFrame:
    """Zero-based position of every row in the given total order."""
    ordered = range_sorted(df, order)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        ordered.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    )
    return ordered.join(F.broadcast(parts), "_part").select(
        *df.columns, (F.col("_before") + F.col("_index")).alias(position)
    )
