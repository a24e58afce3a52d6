"""Fixed-size token blocks from a shuffled stream of texts."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceflow.functions.text import piece_count, pieces
from traceflow.operators.ranking import hash_positions


def pack_blocks(
    texts: DataFrame,
    keys: Sequence[str],
    text: str = "text",
    block_size: int = 128,
    seed: int = 1,
    tokenize=pieces,
    count=piece_count,
    digits: int | Sequence[int] | None = None,
) -> DataFrame:
    """``block, tokens``: consecutive blocks of the texts in seeded hash order.

    Tokens left over after the last full block are dropped. Prefix sums of the
    token counts place each text in the stream; a text is then cut at the block
    borders, so whole slices are moved instead of single tokens. Only keys and
    counts are ranked, as ``hash_positions`` has it; ``keys`` must identify a text.
    """
    named = texts.select(*keys, F.col(text).alias("_text"))
    counts = named.select(*keys, count("_text").alias("_count"))
    ranked = hash_positions(
        counts, keys, seed, position="_start", weight="_count", total="_stream", digits=digits
    ).where(F.col("_count") > 0)
    placed = named.join(ranked, list(keys))

    def block_of(position: Column) -> Column:
        return F.floor(position / F.lit(block_size)).cast("long")

    start, size = F.col("_start"), F.col("_count")
    blocks = F.sequence(block_of(start), block_of(start + size - 1))

    def cut(tokens: Column) -> Column:
        def one(block: Column) -> Column:
            begin = F.greatest(block * block_size, start)
            end = F.least((block + 1) * block_size, start + size)
            return F.struct(
                block.alias("block"),
                begin.alias("begin"),
                F.slice(
                    tokens, (begin - start + 1).cast("int"), (end - begin).cast("int")
                ).alias("tokens"),
            )

        return F.transform(blocks, one)

    # The one-element array makes each text be tokenized once, not once a block.
    slices = F.flatten(F.transform(F.array(tokenize(F.col("_text"))), cut))
    return (
        placed.select("_stream", F.explode(slices).alias("_slice"))
        .where(F.col("_slice.block") < block_of(F.col("_stream")))
        .groupBy(F.col("_slice.block").alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("_slice.begin", "_slice.tokens"))).alias("_all"))
        .select("block", F.flatten("_all.tokens").alias("tokens"))
    )
