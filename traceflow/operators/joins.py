"""Joins against lookup tables that stay balanced when a key is hot."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceflow.session import checkpoint

# A lookup table is broadcast only when it is measured to be below both bounds.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024

# Rows of one key that one task is to handle; a key with more is hot.
HOT_ROWS = 2_000_000


def row_bytes(df: DataFrame) -> Column:
    """Approximate size of a row: texts and lists by content, the rest 8 bytes each."""
    size = F.lit(8 * len(df.columns)).cast("long")
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = size + F.coalesce(F.octet_length(F.to_json(field.name)), F.lit(0))
    return size


def fits_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Measure ``df`` and tell whether it may be broadcast."""
    size = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(row_bytes(df)).alias("bytes")).first()
    return size["rows"] <= max_rows and (size["bytes"] or 0) <= max_bytes


def hot_keys(rows: DataFrame, key: str, min_rows: int = HOT_ROWS) -> DataFrame | None:
    """Keys that own too many rows for one task, with their row counts.

    Returns None when there are none. The counts are pre-aggregated on the map
    side, and only the largest comes to the driver. There are at most ``rows / min_rows`` hot
    keys; the list is written to the shared folder and stays distributed.
    """
    counts = (
        rows.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("key_rows"))
    )
    top = counts.agg(F.max("key_rows")).first()[0]
    if top is None or top <= min_rows:
        return None
    return checkpoint(counts.where(F.col("key_rows") > min_rows))


def small_side(hot: DataFrame) -> DataFrame:
    """A list of hot keys for a join, broadcast while it is small."""
    return F.broadcast(hot) if fits_broadcast(hot) else hot


def salted_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: str,
    how: str = "inner",
    row_key: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Shuffle join that spreads each hot key over one task per ``hot_rows`` rows.

    ``row_key`` names columns that differ between the rows of one hot key.
    """
    hot = hot_keys(rows, on, hot_rows)
    if hot is None:
        return rows.join(lookup, on, how)
    salts = F.ceil(F.col("key_rows") / F.lit(max(1, hot_rows))).cast("int")
    hot = small_side(hot.select(on, salts.alias("_salts")))
    salt = F.pmod(F.xxhash64(*(row_key or rows.columns)), F.col("_salts")).cast("int")
    left = rows.join(hot, on, "left").withColumn("_salt", F.coalesce(salt, F.lit(0)))
    copies = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    right = lookup.join(hot, on, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    return left.drop("_salts").join(right, [on, "_salt"], how).drop("_salt")


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: str,
    how: str = "left",
    row_key: Sequence[str] = (),
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int = BROADCAST_BYTES,
    hot_rows: int = HOT_ROWS,
    bound: DataFrame | None = None,
) -> DataFrame:
    """Join rows with a lookup table: broadcast if it is small, else salted.

    ``bound`` is a table that is cheaper to measure and at least as large.
    """
    if fits_broadcast(lookup if bound is None else bound, max_rows, max_bytes):
        return rows.join(F.broadcast(lookup), on, how)
    return salted_join(rows, lookup, on, how, row_key, hot_rows)
