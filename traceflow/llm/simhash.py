"""SimHash near-duplicates found by covering locality-sensitive hashing.

Documents link when their 64-bit fingerprints differ in at most two bits. A
linear map gives each bit a non-zero code of three bits; table ``v`` (1..7)
keeps the bits whose code has odd overlap with ``v``. The codes of any two bits
are both orthogonal to at least one ``v``, so every pair within the radius
agrees on all kept bits of some table: no pair can be missed.
"""

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceflow.llm.common import store, utf8
from traceflow.llm.components import components

RADIUS = 2
SHINGLE = 3
SEED = 42
# Buckets up to this size are compared pair by pair, larger ones by one-bit variants.
PAIR_BUCKET = 32


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def covering_masks() -> list[int]:
    """Seven 64-bit masks; any two bits are both outside at least one of them."""
    codes = [bit % 7 + 1 for bit in range(64)]
    return [
        sum(1 << bit for bit in range(64) if (codes[bit] & v).bit_count() % 2) for v in range(1, 8)
    ]


def fingerprint(text: bytes | None) -> int:
    """SimHash of the 3-word shingles of a text; zero without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    last = ends[SHINGLE - 1 :] or ends[-1:]
    digest = xxhash.xxh64_digest
    hashes = b"".join(
        [digest(joined[a : b - 1], SEED) for a, b in zip(starts, last, strict=False)]
    )
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    # 16-bit sums are quick and exact below 2**16 rows
    count = sum(
        bits[i : i + 65_000].sum(axis=0, dtype=np.uint16).astype(np.int64)
        for i in range(0, len(bits), 65_000)
    )
    return int.from_bytes(np.packbits(2 * count > len(bits)).tobytes(), "big")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = [_signed(fingerprint(text.as_py())) for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(marks, pa.int64())], names=["doc_id", "mark"]
        )


def _marked_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = [_signed(fingerprint(text.as_py())) for text in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(marks, pa.int64())], names=["doc_id", "digest", "mark"]
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, mark): the SimHash of every row's whole text as a signed long."""
    rows = docs.select("doc_id", utf8("text").alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, mark long"
    return rows.mapInArrow(_fingerprint_batches, schema)


def _differing_bits(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def fingerprint_links(nodes: DataFrame, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """Links (u, v) that join all nodes (id, mark) within the radius of each other.

    Marks are distinct. Members of a small bucket are compared with each other.
    A large bucket is resolved without pairs: each member is dealt to itself
    and its 64 one-bit variants, and two marks share a variant exactly when they
    differ in at most two bits, so one link per member and variant, to the
    smallest id there, connects what pairs would connect.
    """
    tables = F.array(
        *[
            F.struct(F.lit(k).alias("table"), F.col("mark").bitwiseAND(F.lit(_signed(m))).alias("key"))
            for k, m in enumerate(covering_masks())
        ]
    )
    dealt = nodes.select("id", "mark", F.inline(tables))
    sizes = dealt.groupBy("table", "key").agg(F.count(F.lit(1)).alias("members"))
    dealt = store(dealt.join(sizes.where("members > 1"), ["table", "key"]))
    small = dealt.where(F.col("members") <= pair_bucket)
    other = small.select("table", "key", F.col("id").alias("v"), F.col("mark").alias("mark_v"))
    pairs = (
        small.withColumnRenamed("id", "u")
        .join(other, ["table", "key"])
        .where((F.col("v") < F.col("u")) & (_differing_bits("mark", "mark_v") <= RADIUS))
        .select("u", "v")
    )
    flips = [F.lit(0).cast("long"), *[F.lit(_signed(1 << i)).cast("long") for i in range(64)]]
    variants = (
        dealt.where(F.col("members") > pair_bucket)
        .select("id", "mark")
        .distinct()
        .select("id", F.explode(F.array(*[F.col("mark").bitwiseXOR(x) for x in flips])).alias("variant"))
    )
    least = variants.groupBy("variant").agg(F.min("id").alias("v"), F.count(F.lit(1)).alias("_n"))
    stars = variants.join(least.where("_n > 1"), "variant").select(F.col("id").alias("u"), "v")
    return pairs.union(stars.where("u <> v"))


def _classes(marks: DataFrame, pair_bucket: int) -> DataFrame:
    """(mark, component_id) of marked rows (doc_id, mark)."""
    nodes = store(marks.groupBy("mark").agg(F.min("doc_id").alias("id")))
    links = fingerprint_links(nodes.where("id is not null"), pair_bucket)
    found = components(links).select(F.col("node").alias("id"), "component")
    return nodes.join(found, "id", "left").select("mark", F.coalesce("component", "id").alias("component_id"))


def near_duplicates(docs: DataFrame, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id.

    ``component_id`` is the smallest doc_id reachable over links, itself
    included. Null and wordless texts have fingerprint zero, which links like
    any other. Texts are read whole. Rows that repeat a doc_id are all returned;
    a null doc_id never names a component unless nothing else is there. An
    empty table gives no rows. Other columns are ignored.
    """
    marks = store(fingerprints(docs))
    hexed = F.lpad(F.lower(F.hex("mark")), 16, "0").alias("fingerprint")
    return marks.join(_classes(marks, pair_bucket), "mark").select("doc_id", hexed, "component_id")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, that of the smallest doc_id.

    A row goes if its own text is of the group of a smaller doc_id; another text under the same id
    is judged by itself. Rows that repeat id and fingerprint count as one document: one of them
    stays. Rows without a doc_id stay. All columns are kept as they are.
    """
    digest = F.xxhash64(F.col("text").cast("string"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", digest.alias("digest"), utf8("text").alias("text"))
    marks = store(rows.mapInArrow(_marked_batches, f"doc_id {kind}, digest long, mark long"))
    judged = marks.join(_classes(marks, PAIR_BUCKET), "mark")
    dropped = judged.where("doc_id <> component_id").select("doc_id", "digest").distinct()
    # Rows that repeat the id and group of a kept one are rare: only ids are grouped, then joined back.
    repeated = (
        judged.where("doc_id = component_id")
        .groupBy("doc_id", "mark")
        .agg(F.count(F.lit(1)).alias("_n"), F.collect_set("digest").alias("_digests"))
        .where("_n > 1")
        .select("doc_id", "mark", F.explode("_digests").alias("digest"))
    )
    keys = [F.col("doc_id").eqNullSafe(F.col("_doc")), digest == F.col("_digest")]

    def named(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest"))

    kept = docs.join(named(dropped), keys, "left_anti")
    repeated = store(repeated)
    if repeated.isEmpty():
        return kept
    # Of texts with one fingerprint under one id, the one with the least digest.
    least = repeated.groupBy("doc_id", "mark").agg(F.min("digest").alias("digest"))
    again = kept.join(named(least), keys, "left_semi").withColumn("_digest", digest)
    once = again.dropDuplicates(["doc_id", "_digest"]).drop("_digest")
    return kept.join(named(repeated), keys, "left_anti").unionByName(once)
