"""Parallel readers of files whose records do not end with a line.

Two formats cannot be cut at line breaks: CSV with breaks inside quotes, and one
JSON array of objects. Both are read here by Spark's text source, which hands out byte ranges of
a file, cut at single bytes: line feeds for CSV, closing braces for JSON. A first pass
tells for each range how it moves the state of a scanner, whatever state it starts in; a prefix scan over
the ranges, one short row each, gives the state every range starts in. The second pass
joins the pieces of each record inside its range, and only records that cross into
another range are put together by a shuffle.
"""

import csv
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceflow.session import checkpoint

# State of the scanner where a record starts.
_FRESH = (0, 0)
# Kinds of pieces: a record, the end of one begun in an earlier range, all of a range
# inside one record, the beginning of one that does not end in its range.
_WHOLE, _HEAD, _MIDDLE, _TAIL = range(4)
_PIECE = "file string, start long, place long, kind int, record binary"


class _Csv:
    """A record ends with a line whose end is outside quotes; doubled quotes cancel out."""

    separator = "\n"

    @staticmethod
    def moves(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per piece: parity of its quotes, change of depth if it starts outside quotes, and inside."""
        quotes = pc.count_substring(values, '"').to_numpy(zero_copy_only=False)
        none = np.zeros(len(values), np.int64)
        return quotes & 1, none, none


class _JsonArray:
    """A record ends with a brace that closes the outermost one, outside of strings."""

    separator = "}"

    @staticmethod
    def moves(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        values = values.cast(pa.string())
        offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
        data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets.astype(np.int64) - offsets[0]
        quote = data == ord('"')
        slashes = np.flatnonzero(data == ord("\\"))
        if len(slashes):
            # The character after an odd number of backslashes is escaped.
            first = np.r_[True, np.diff(slashes) != 1]
            runs = np.diff(np.r_[np.flatnonzero(first), len(slashes)])
            after = slashes[first] + runs
            escaped = after[(runs % 2 == 1) & (after < len(data))]
            quote[escaped] = False
        seen = np.r_[0, np.cumsum(quote)]
        inside = seen[:-1] & 1
        opened = np.flatnonzero(data == ord("{"))
        owner = np.searchsorted(offsets, opened, "right") - 1
        # Quotes before a brace in its own piece, for a piece that starts outside a string.
        within = (inside[opened] ^ (seen[offsets[owner]] & 1)) == 1 if len(opened) else np.zeros(0, bool)
        parity = (seen[offsets[1:]] - seen[offsets[:-1]]) & 1
        outside_first = np.bincount(owner[~within], minlength=len(values))
        inside_first = np.bincount(owner[within], minlength=len(values))
        # The brace that ends the piece closes one if it is outside a string.
        return parity, outside_first - (parity == 0), inside_first - (parity == 1)


_FORMATS = {"csv": _Csv, "json": _JsonArray}


def _follow(parity: np.ndarray, plain: np.ndarray, quoted: np.ndarray, state: tuple[int, int]):
    """Parity and depth after each piece."""
    parity_after = (np.cumsum(parity) + state[0]) & 1
    before = np.r_[state[0], parity_after[:-1]]
    return parity_after, state[1] + np.cumsum(np.where(before == 1, quoted, plain))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Parts of batches that belong to one range, with (file, start)."""
    for batch in batches:
        file, start = batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
        codes = file.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.r_[True, (np.diff(start) != 0) | (np.diff(codes) != 0)][: len(start)])
        for a, b in zip(cuts, [*cuts[1:], len(start)], strict=True):
            yield (file[int(a)].as_py(), int(start[a])), batch.slice(int(a), int(b - a))


def _summaries(kind: str):
    """One row per range: how it changes parity, and depth from either parity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None
        for key, part in _blocks(batches):
            if key != now:
                if now is not None:
                    yield _summary(now, sums)
                now, sums = key, [(0, 0), (1, 0)]
            moves = _FORMATS[kind].moves(part.column(0))
            for k in (0, 1):
                parity, depth = _follow(*moves, sums[k])
                sums[k] = (int(parity[-1]), int(depth[-1]))
        if now is not None:
            yield _summary(now, sums)

    return run


def _summary(key: tuple, sums: list[tuple[int, int]]) -> pa.RecordBatch:
    values = [key[0], key[1], sums[0][0], sums[0][1], sums[1][1]]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    names = ["file", "start", "parity", "plain", "quoted"]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)


def _records(kind: str):
    """Joins pieces inside a range; the state it starts in comes with the rows."""
    separator = _FORMATS[kind].separator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, pending, place, leads = None, None, [], 0, False
        for key, part in _blocks(batches):
            if key != now:
                if now is not None and pending:
                    yield _piece(now, place, _MIDDLE if leads else _TAIL, pending, separator)
                now, pending, place = key, [], 0
                if not part.column(3)[0].is_valid:
                    raise ValueError("the byte ranges of a file changed while it was read")
                state = (part.column(3)[0].as_py(), part.column(4)[0].as_py())
                leads = state != _FRESH
            values = part.column(0)
            parity, depth = _follow(*_FORMATS[kind].moves(values), state)
            state = (int(parity[-1]), int(depth[-1]))
            ends = np.flatnonzero((parity == 0) & (depth == 0)) + 1
            if len(ends) and (pending or leads):
                pending.append(values.slice(0, int(ends[0])))
                yield _piece(now, place, _HEAD if leads else _WHOLE, pending, separator)
                place += not leads
                values, ends = values.slice(int(ends[0])), ends[1:] - ends[0]
                pending, leads = [], False
            if len(ends):
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), values.slice(0, int(ends[-1])))
                joined = pc.binary_join(lists, separator)
                many = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([now[0]] * many, pa.string()),
                        pa.array([now[1]] * many, pa.int64()),
                        pa.array(np.arange(place, place + many), pa.int64()),
                        pa.array([_WHOLE] * many, pa.int32()),
                        joined.cast(pa.binary()),
                    ],
                    names=["file", "start", "place", "kind", "record"],
                )
                place += many
                values = values.slice(int(ends[-1]))
            if len(values):
                pending.append(values)
        if now is not None and pending:
            yield _piece(now, place, _MIDDLE if leads else _TAIL, pending, separator)

    return run


def _piece(key: tuple, place: int, kind: int, parts: list[pa.Array], separator: str) -> pa.RecordBatch:
    text = separator.join(s for p in parts for s in p.to_pylist())
    values = [key[0], key[1], place, kind, text.encode()]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    names = ["file", "start", "place", "kind", "record"]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)


def read_records(spark: SparkSession, path: str | list[str], kind: str) -> DataFrame:
    """The records of files of kind ``csv`` or ``json``: file, place, record.

    ``place`` counts the records of a file from zero, whatever its byte ranges are. The records are
    written to the shared folder once, as later reads of the files may cut them differently.

    CSV records are quoted as RFC 4180 has it: a field with a quote, comma or line break is in quotes, and
    quotes inside are doubled. A JSON file is one array of objects. Empty files give nothing;
    what follows the last complete record is a record of its own, unless it only closes the array.
    """
    rows = spark.read.option("lineSep", _FORMATS[kind].separator).text(path)
    pieces = rows.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )
    moved = checkpoint(pieces.mapInArrow(_summaries(kind), "file string, start long, parity int, plain long, quoted long"))
    # One row per range, so a file's ranges fit a task; two longs of each are broadcast.
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    parity = F.coalesce(F.sum("parity").over(earlier), F.lit(0)) % 2
    at_start = moved.withColumn("_in", parity.cast("int"))
    change = F.when(F.col("_in") == 1, F.col("quoted")).otherwise(F.col("plain"))
    depth = F.coalesce(F.sum(change).over(earlier), F.lit(0)).cast("long")
    states = at_start.select(F.xxhash64("file", "start").alias("_range"), "_in", depth.alias("_depth"))
    started = (
        pieces.withColumn("_range", F.xxhash64("file", "start"))
        .join(F.broadcast(states), "_range", "left")
        .select("value", "file", "start", "_in", "_depth")
    )
    found = checkpoint(started.mapInArrow(_records(kind), _PIECE))
    whole = found.where(F.col("kind") == _WHOLE).select("file", "start", "place", "record")
    records = whole.unionByName(_crossing(found.where(F.col("kind") != _WHOLE), _FORMATS[kind].separator))
    if kind == "json":
        records = records.where(F.trim(F.regexp_replace(F.col("record").cast("string"), r"[\s\[\],]+", "")) != "")
    counts = records.groupBy("file", "start").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(
        F.xxhash64("file", "start").alias("_range"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    return (
        records.withColumn("_range", F.xxhash64("file", "start"))
        .join(F.broadcast(before), "_range")
        .select("file", (F.col("_before") + F.col("place")).alias("place"), F.col("record").cast("string").alias("record"))
    )


def _crossing(pieces: DataFrame, separator: str) -> DataFrame:
    """Records put together from a tail, whole ranges and a head; there are at most two pieces a range.

    A head comes before the tail of its range.
    """
    order = Window.partitionBy("file").orderBy("start", "kind")
    begun = F.sum((F.col("kind") == _TAIL).cast("long")).over(order)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("start", "kind", "place", "record"))), lambda p: p["record"])
    first = F.min(F.struct("start", "kind", "place"))
    return (
        pieces.withColumn("_no", begun)
        .groupBy("file", "_no")
        .agg(parts.alias("_parts"), first.alias("_first"))
        .select(
            "file",
            F.col("_first.start").alias("start"),
            F.col("_first.place").alias("place"),
            F.array_join(F.col("_parts").cast("array<string>"), separator).cast("binary").alias("record"),
        )
    )


def read_quoted_csv(spark: SparkSession, path: str | list[str], position: str | None = None) -> DataFrame:
    """CSV with a header, all columns as text, read by many tasks though fields may hold line breaks.

    The rows are those of ``spark.read.csv(header=True, multiLine=True, escape='"')`` on the same files.
    The names are those of the first file's header; each file's first record is its header. ``position``
    names a column that orders the rows of a file as they stand there; blank lines leave gaps in it.
    """
    records = read_records(spark, path, "csv")
    # An empty line is no record to the reader, and the first line tells how lines end.
    rows = records.where(~F.col("record").isin("", "\r"))
    first = F.min(F.struct("place", F.endswith(F.substring_index("record", "\n", 1), F.lit("\r")).alias("crlf")))
    heads = rows.groupBy("file").agg(first.alias("_head")).select("file", F.col("_head.place").alias("_head"), "_head.crlf")
    unified = F.regexp_replace(F.regexp_replace("record", "\r\n", "\n"), "\r$", "")
    body = rows.join(F.broadcast(heads), "file").withColumn("record", F.when(F.col("crlf"), unified).otherwise(F.col("record")))
    head = body.where("place = _head").orderBy("file").select("record").first()
    if head is None:
        return spark.createDataFrame([], T.StructType([]))
    names = [n or f"_c{i}" for i, n in enumerate(next(csv.reader(io.StringIO(head["record"], newline=""))))]
    options = {"escape": '"', "multiLine": "true"}
    schema = ", ".join(f"`c{i}` string" for i in range(len(names)))
    parsed = body.where("place > _head").select(
        F.from_csv("record", schema, options).alias("row"), (F.col("place") - F.col("_head") - 1).alias("_pos")
    )
    columns = [F.col(f"row.c{i}").alias(n) for i, n in enumerate(names)]
    return parsed.select(*columns, *([F.col("_pos").alias(position)] if position else []))


def read_json_array(spark: SparkSession, path: str | list[str], schema: T.StructType, position: str = "place") -> DataFrame:
    """The objects of files that are one JSON array each, with their place in the file.

    NaN and infinities are read; a record that is no such object gives a row of nulls.
    """
    records = read_records(spark, path, "json")
    text = F.regexp_replace("record", r"^[\s,\[\]]+", "")
    parsed = records.select("place", F.from_json(F.concat(text, F.lit("}")), schema, {"mode": "PERMISSIVE"}).alias("row"))
    return parsed.select("row.*", F.col("place").alias(position))
