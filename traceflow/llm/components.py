"""Connected components of a link table by alternating star contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceflow.llm.common import store


def _with_least(links: DataFrame) -> DataFrame:
    """Each (u, v) with the least of u and all its neighbours."""
    least = links.groupBy("u").agg(F.min("v").alias("_least"))
    return links.join(least, "u").select("u", "v", F.least("u", "_least").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    stars = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return stars.where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    stars = _with_least(down)
    return (
        stars.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(stars.select("u", F.col("m").alias("v")))
        .where("u <> v")
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns u, v, same type).

    ``component`` is the least node reachable. Self links and repeated links
    change nothing, and a node without links to others is not returned. Each
    round is two joins on a pre-aggregated least neighbour, written to the shared folder, so no
    node's neighbours ever meet in one task or on the driver; rounds grow with
    the logarithm of the longest chain.
    """
    now = store(links.select("u", "v").where("u <> v").distinct())
    before = None
    while True:
        digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        state = now.agg(F.count(F.lit(1)), digest).first()
        if state == before or state[0] == 0:
            break
        before = state
        now = store(_small_star(_large_star(now)))
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.union(now.select(F.col("v"), F.col("v")).distinct())
