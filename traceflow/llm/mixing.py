"""Mixing of sources by weighted fair queueing, in DataFrame functions only.

Every source is a flow whose rate is its target. A document's virtual finish
time is the words its source has served up to its end, over the target; the
second pass over a source follows the first. Each pass of a document is a packet,
in two where its flow's target falls inside it. Packets are range sorted by
virtual finish time over all sources and the queue is truncated at the total
budget: sums per range tell which ranges are served, and only the one in which
the budget ends is summed packet by packet.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceflow.llm.common import store
from traceflow.operators.ranking import range_sorted

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
REPEATS = 2
SEED = 17
# Documents of a source that are ranked in one task.
BUCKET_ROWS = 4096


def word_count(text: str = "text") -> Column:
    """Runs of anything but blank, tab and line ends; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    budget: float = BUDGET,
    repeats: int = REPEATS,
) -> DataFrame:
    """(source, source_size, source_rows, target) from (source, size) per document.

    Sources in code point order, null last, take the weights in turn and share
    ``budget`` times all words. A target stops at ``repeats`` times its source;
    what is over is shared anew by weight: with sources in order of cap per
    weight, the level is the first that the rest of the budget does not lift
    above the next cap.
    """
    totals = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows")
    )
    # One row per source from here on.
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    cap = (F.lit(repeats) * F.col("source_size")).alias("_cap")
    flows = totals.select("*", weight.alias("_weight"), cap)
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        F.lit(float(budget)) * F.sum("source_size").over(everything)
        - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    ) / F.sum("_weight").over(after)
    # Once a level stays under its cap, it is the level of all that follow.
    open_level = F.when(level * F.col("_weight") <= F.col("_cap"), level)
    common = F.first(open_level, ignorenulls=True).over(everything)
    levelled = flows.select("*", common.alias("_level"))
    target = F.least(F.coalesce(F.col("_level") * F.col("_weight"), F.col("_cap").cast("double")), F.col("_cap").cast("double"))
    return levelled.select("source", "source_size", "source_rows", target.alias("target"))


def plan_mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    budget: float = BUDGET,
    repeats: int = REPEATS,
    seed: int = SEED,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, first_finish.

    ``taken`` counts the words the mix takes of the document over all passes,
    at most ``repeats * size``: those of its packets ahead of the cut. They add up
    to each source's target, rounded down. ``first_finish`` is the virtual finish time of the first pass (null
    for a source without words). Order within a source is a seeded hash of
    doc_id, ties by doc_id and size, so reruns agree. A null source is a source
    of its own; a null or wordless text has size 0 and nothing is taken of it.
    Rows that repeat a doc_id are documents of their own. Texts take no part in
    any shuffle. A source is ranked in buckets of about ``bucket_rows`` rows,
    so one source may own any share of the corpus.
    """
    text_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), text_id))
    order = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    sizes = store(docs.select("doc_id", "source", word_count().alias("size"), order.alias("_order")))
    targets = source_targets(sizes, weights, budget, repeats)
    # Hash order cut into equal ranges: as many as the source needs.
    share = F.col("_order") / F.lit(float(2**60))
    buckets = F.ceil(F.col("source_rows") / bucket_rows)
    known = F.col("sizes.source").eqNullSafe(F.col("targets.source"))
    flows = (
        sizes.alias("sizes")
        .join(targets.alias("targets"), known)
        .select("doc_id", "sizes.source", "size", "_order", "source_size", "target", F.floor(share * buckets).alias("_bucket"))
    )
    totals = flows.groupBy("source", "_bucket").agg(F.sum("size").alias("_words"))
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("source").alias("_source"),
        F.col("_bucket").alias("_bucket_of"),
        F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_offset"),
    )
    inside = Window.partitionBy("source", "_bucket").orderBy("_order", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # Rows that are equal in all these are told apart by their number.
    number = F.row_number().over(Window.partitionBy("source", "_bucket").orderBy("_order", "doc_id", "size"))
    served = flows.select("*", F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("_inside"), number.alias("_number"))
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_bucket_of"))
    served = served.join(offsets, same).withColumn("_start", F.col("_offset") + F.col("_inside"))
    finish = F.try_divide((F.col("_start") + F.col("size")).cast("double"), F.col("target"))
    document = ["doc_id", "source", "size", "source_size", "target", "first_finish", "_bucket", "_number"]
    queue = packets(served.withColumn("first_finish", finish), repeats).select(
        *document, "turn", "words", "finish", "beyond"
    )
    words = targets.agg(F.sum(F.floor("target"))).first()[0] or 0
    taken = cut_at_budget(queue, int(words)).groupBy(*document).agg(F.sum("served").alias("taken"))
    return taken.select("doc_id", "source", "size", "source_size", "target", "taken", "first_finish")


def packets(flows: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """The packets of each row of ``flows`` (size, source_size, target, _start): turn, words, finish, beyond added.

    One for each pass, or two where the flow's target, in whole words, falls
    inside it; ``beyond`` is 1 for what is past the target. A wordless document
    has one packet of no words.
    """
    goal = F.floor("target").cast("long")
    made = []
    for turn in range(repeats):
        start = F.col("_start") + F.lit(turn) * F.col("source_size")
        own = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), goal - start))
        for beyond, words, end in ((0, own, start + own), (1, F.col("size") - own, start + F.col("size"))):
            finish = F.try_divide(end.cast("double"), F.col("target"))
            made.append(
                F.struct(
                    F.lit(turn).alias("turn"), words.alias("words"), finish.alias("finish"), F.lit(beyond).alias("beyond")
                )
            )
    full = F.filter(F.array(*made), lambda p: p["words"] > 0)
    return flows.select("*", F.explode(F.when(F.col("size") > 0, full).otherwise(F.array(made[0]))).alias("_p")).select(
        *flows.columns, "_p.*"
    )


def cut_at_budget(queue: DataFrame, words: int) -> DataFrame:
    """The packets range sorted by virtual finish time, with ``served``: the words ahead of the cut after ``words`` words.

    Ties go to packets within their flow's target, then by source, bucket, number and turn.
    """
    order = ["finish", "beyond", "source", "_bucket", "_number", "turn"]
    ordered = range_sorted(queue, [F.col(name).asc() for name in order])
    sums = ordered.groupBy("_part").agg(F.sum("words").alias("_words"))
    # One row per partition of the sort.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.select("_part", "_words", F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_before"))
    left = F.greatest(F.lit(0).cast("long"), F.lit(words) - F.col("_before"))
    placed = ordered.join(F.broadcast(parts.select("_part", "_words", left.alias("_left"))), "_part")
    ends_here = (F.col("_left") > 0) & (F.col("_left") < F.col("_words"))
    whole = placed.where(~ends_here).withColumn("served", F.when(F.col("_left") > 0, F.col("words")).otherwise(0))
    before = Window.partitionBy("_part").orderBy("_index").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.greatest(F.lit(0).cast("long"), F.col("_left") - F.coalesce(F.sum("words").over(before), F.lit(0)))
    cut = placed.where(ends_here).withColumn("served", F.least(F.col("words"), rest))
    return whole.unionByName(cut).drop("_part", "_index", "_words", "_left")


def queue_order(plan: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """The mix as a globally range-sorted queue: one row per document and pass that is taken.

    Columns doc_id, source, turn, words, finish. Turn ``t`` of a document
    finishes ``t * source_size / target`` after its first.
    """
    turn = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("turn")
    words = F.least(F.col("size"), F.col("taken") - F.col("turn") * F.col("size"))
    finish = F.col("first_finish") + F.col("turn") * F.col("source_size") / F.col("target")
    return (
        plan.where("taken > 0")
        .select("*", turn)
        .select("doc_id", "source", "turn", words.alias("words"), finish.alias("finish"))
        .where("words > 0")
        .orderBy("finish", "source", "doc_id", "turn")
    )
