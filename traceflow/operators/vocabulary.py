"""Vocabularies and mean word vectors of texts."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceflow.functions.text import words
from traceflow.operators.joins import fits_broadcast

# More positions than a text can have.
_POSITIONS = 2**31
# Bytes of vectors, and of texts, that meet in one task when vectors are too many to be broadcast.
BLOCK_BYTES, SLICE_BYTES = 64 * 1024 * 1024, 64 * 1024 * 1024
# Texts whose words are added up at once.
_TEXTS = 256


def vocabulary(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, word, ix``: the words of each text numbered by first appearance."""
    return documents.select(
        doc, F.posexplode(F.array_distinct(words(text))).alias("ix", "word")
    ).select(doc, "word", "ix")


def word_counts(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Occurrences of each word in all texts and the place it appears first.

    Text ids are whole numbers. Id and position are compared as one decimal,
    which keeps the aggregate hash based and complete before the shuffle.
    """
    positions = F.lit(_POSITIONS).cast("decimal(11,0)")
    place = F.col(doc).cast("decimal(20,0)") * positions + F.col("pos")
    first_pos = F.pmod(F.col("_first"), positions)
    return (
        documents.select(doc, F.posexplode(words(text)).alias("pos", "word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("occurrences"), F.min(place).alias("_first"))
        .select(
            "word",
            "occurrences",
            ((F.col("_first") - first_pos) / positions).cast("long").alias("first_doc"),
            first_pos.cast("int").alias("first_pos"),
        )
    )


def mean_vectors(
    documents: DataFrame,
    vectors: DataFrame,
    word_key: Callable[[Column], Column],
    doc: str = "doc_id",
    text: str = "text",
    dim: int | None = None,
) -> DataFrame:
    """Mean of the vectors of a text's words, every occurrence counted.

    ``vectors`` has ``vec_id, embedding``; ``word_key`` maps a word column to a
    ``vec_id``. Words without a vector do not count, and a text without a known
    word has a NULL mean. A vector of another length than ``dim``, by default
    that of one vector of the table, is an error. A small vector table is broadcast and texts are
    moved once, by their id. A larger one is cut into blocks: the words of each text, counted per block, meet their
    block in tasks of a bounded share of the texts, and only a text's mean per block goes on.
    """
    if dim is None:
        dim = (vectors.select(F.size("embedding")).first() or [0])[0]
    known = documents.where(F.col(doc).isNotNull())
    length = F.concat(F.lit("vector of another length: "), F.col("vec_id").cast("string"))
    kind = vectors.schema["embedding"].dataType
    checked = F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(F.raise_error(length).cast(kind))

    def keys(texts: DataFrame) -> DataFrame:
        found = texts.select(doc, F.explode(words(text)).alias("_word")).select(doc, word_key(F.col("_word")).alias("vec_id"))
        return found.where(F.col("vec_id").isNotNull())

    if fits_broadcast(vectors.select("vec_id", "embedding")):
        table = vectors.select("vec_id", array_to_vector(checked.cast("array<double>")).alias("_vector"))
        # With all words of a text in one place neither the counts nor the sums move.
        counted = keys(known.select(doc, text).repartition(doc)).groupBy(doc, "vec_id")
        parts = counted.agg(F.count(F.lit(1)).cast("double").alias("_times")).join(F.broadcast(table), "vec_id")
    else:
        table = vectors.select("vec_id", checked.alias("embedding"))
        parts = _block_means(known.select(doc, text), keys, table, doc, text, dim).repartition(doc)
    mean = Summarizer.mean(F.col("_vector"), F.col("_times"))
    means = parts.groupBy(doc).agg(vector_to_array(mean).alias("embedding"))
    return documents.select(doc).join(means, doc, "left")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (text id, block, vec_id), per text and block of a batch: its distinct vec_ids and how often each occurs."""
    for batch in batches:
        if not batch.num_rows:
            continue
        docs, ids = (batch.column(c).dictionary_encode() for c in (0, 2))
        blocks = batch.column(1).to_numpy()
        many, doc_of = len(ids.dictionary), docs.indices.to_numpy().astype(np.int64)
        pairs, first, times = np.unique(doc_of * many + ids.indices.to_numpy(), return_index=True, return_counts=True)
        order = np.lexsort((blocks[first], pairs // many))
        first, times = first[order], times[order]
        owner, block = doc_of[first], blocks[first]
        cuts = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])])
        offsets = pa.array(np.r_[cuts, len(first)].astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(first[cuts])),
                pa.array(block[cuts], pa.int32()),
                pa.ListArray.from_arrays(offsets, batch.column(2).take(pa.array(first))),
                pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))),
            ],
            names=["_doc", "_block", "_ids", "_counts"],
        )


def _block_means(
    texts: DataFrame, keys: Callable[[DataFrame], DataFrame], table: DataFrame, doc: str, text: str, dim: int
) -> DataFrame:
    """``doc, _vector, _times``: weighted means of the vectors of a text's words, each over one block of ``table``."""
    blocks = max(1, -(-table.count() * 8 * dim // BLOCK_BYTES))
    size = texts.agg(F.sum(F.octet_length(text)).cast("long")).first()[0] or 0
    slices = max(1, -(-size // (blocks * SLICE_BYTES)))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("_block")
    id_kind, key = (f.dataType.simpleString() for f in (texts.schema[doc], table.schema["vec_id"]))
    found = keys(texts)
    # Ids of the two sides are compared as they are in the table.
    found = found.select(doc, F.col("vec_id").cast(key).alias("vec_id")).select(doc, block, "vec_id")
    counted = found.mapInArrow(_counts, f"_doc {id_kind}, _block int, _ids array<{key}>, _counts array<int>")
    counted = counted.withColumn("_slice", F.pmod(F.xxhash64("_doc"), F.lit(slices)).cast("int"))
    copies = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("_slice")
    table = table.where("vec_id is not null").select("vec_id", "embedding", block, copies)

    def means(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        owners, sums, weights = [], [], []
        if left.num_rows and right.num_rows:
            ids = pc.unique(right["vec_id"])
            place = pc.index_in(right["vec_id"], value_set=ids).to_numpy()
            flat = pc.list_flatten(right["embedding"])
            if flat.null_count:
                raise ValueError("a vector holds a null")
            # A vec_id that occurs twice counts with each of its vectors.
            vectors, copies = np.zeros((len(ids), dim)), np.bincount(place, minlength=len(ids))
            np.add.at(vectors, place, flat.to_numpy().reshape(-1, dim))
            for at in range(0, left.num_rows, _TEXTS):
                part = left.slice(at, _TEXTS)
                owner = pc.list_parent_indices(part["_ids"]).to_numpy()
                row = pc.index_in(pc.list_flatten(part["_ids"]), value_set=ids)
                has = row.is_valid().to_numpy()
                owner, row = owner[has], pc.drop_null(row).to_numpy()
                times = pc.list_flatten(part["_counts"]).to_numpy()[has].astype(np.float64)
                if not len(row):
                    continue
                cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                weight = np.add.reduceat(times * copies[row], cuts)
                sums.append(np.add.reduceat(vectors[row] * times[:, None], cuts) / weight[:, None])
                weights.append(weight)
                owners.append(part["_doc"].take(pa.array(owner[cuts])).combine_chunks())
        docs = pa.chunked_array(owners, left.schema.field("_doc").type)
        flat = np.concatenate(sums).ravel() if sums else np.zeros(0)
        ends = np.arange(0, len(flat) + 1, dim, dtype=np.int32)
        return pa.table(
            {
                doc: docs,
                "_mean": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                "_times": np.concatenate(weights) if weights else np.zeros(0),
            }
        )

    met = counted.groupBy("_block", "_slice").cogroup(table.groupBy("_block", "_slice"))
    found = met.applyInArrow(means, f"{doc} {id_kind}, _mean array<double>, _times double")
    return found.select(doc, array_to_vector("_mean").alias("_vector"), "_times")
