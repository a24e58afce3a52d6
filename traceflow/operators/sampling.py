"""Class balancing and seeded shuffles."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceflow.operators.ranking import BUCKET_ROWS, HASH_DIGITS, hash_order


def downsample(
    rows: DataFrame,
    label: str,
    keys: Sequence[str],
    seed: int = 42,
    digits: int = HASH_DIGITS,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Keep at most as many rows of label 1 as there are of label 0.

    The kept rows are the first in seeded hash order; rows of other labels are
    dropped. Counts per hash bucket tell in which bucket the quota ends; while that one has more than
    ``bucket_rows`` rows of label 1, it alone is counted again by further digits. Only the last
    bucket is ranked, and no other row moves. The input is read once per count and twice more, so persist it if it
    is costly to compute.
    """
    y, taken_prefix = F.col(label), ""
    hashed = rows.where(y.isin(0, 1)).withColumn("_hash", hash_order(seed, *keys))
    room = None
    while True:
        bucket = F.substring("_hash", 1, len(taken_prefix) + digits)
        inside = F.startswith("_hash", F.lit(taken_prefix)) | F.lit(room is None)
        counts = (
            hashed.where(inside & ((y == 1) | F.lit(room is None)))
            .groupBy(bucket.alias("_bucket"))
            .agg(F.count_if(y == 0).alias("zeros"), F.count_if(y == 1).alias("ones"))
            .collect()
        )
        if room is None:
            room = sum(r["zeros"] for r in counts)
        edge = None
        for r in sorted(counts, key=lambda r: r["_bucket"]):
            if r["ones"] > room:
                edge = r
                break
            room -= r["ones"]
        if edge is None:
            return rows.where(y.isin(0, 1))
        taken_prefix = edge["_bucket"]
        if edge["ones"] <= bucket_rows or len(taken_prefix) >= 32:
            break
    bucket = F.substring("_hash", 1, len(taken_prefix))
    whole = hashed.where((y == 0) | (bucket < taken_prefix))
    last = hashed.where((y == 1) & (bucket == taken_prefix)).orderBy("_hash", *keys).limit(room)
    return whole.select(*rows.columns).unionByName(last.select(*rows.columns))


def shuffled(rows: DataFrame, keys: Sequence[str], seed: int = 1) -> DataFrame:
    """Rows sorted by a seeded hash of their keys; for output whose order shows."""
    return rows.orderBy(hash_order(seed, *keys), *keys)
