"""Hard negatives by a secondary sort of scored pairs.

Anchors, a stated part of the rows, are scored against all rows in blocks. Pairs
travel under keys (anchor, descending score, id) and are sorted inside the partitions
of the anchor; an iterator then reads each anchor's rows from the best score down,
opens a window of scores at each of its first positives, and emits the rows of other labels that
fall into open windows. It holds a few numbers per anchor, never its rows.

Only pairs that can be emitted are shuffled. A block of rows hands on the first
few rows of the anchor's label, which hold all its positives there; once the positives are known,
the first few rows of other labels in each window.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceflow.llm.common import store

POSITIVES = 5
NEGATIVES = 3
# Percent of the positive's score a negative has at least and at most.
WINDOW = (50, 95)
# Anchors of a tile, rows of a block, and blocks that meet a tile of anchors in one cell.
TILE = 4096
BLOCK = 1024
GROUP = 16
# Partitions of cells at most; beyond it a task takes several cells.
_CELL_TASKS = 20_000

_PAIR = "anchor long, place long, score long, negative int, id long, mark long"


def scaled(vector: str = "embedding") -> Column:
    """floor(256 * x) of every component as a double."""
    return F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * 256).cast("double"))


def usable(label: str = "label", vector: str = "embedding") -> Column:
    """Whether a row takes part: label and vector there, all components finite."""
    bad = F.exists(F.col(vector).cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(label).isNotNull() & F.col(vector).isNotNull() & F.coalesce(~bad, F.lit(False))


def _exact_kind(left: np.ndarray, right: np.ndarray) -> type:
    """A kind of number in which all products of the rows are exact."""
    most = left.shape[1] * float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0))
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


def scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows, held to the range of a long."""
    kind = _exact_kind(left, right)
    if kind is object:
        whole = [np.array([[int(x) for x in row] for row in side], object).reshape(side.shape) for side in (left, right)]
        product = whole[0] @ whole[1].T
        top = (1 << 63) - 1
        return np.array([[min(max(int(x), -top), top) for x in row] for row in product], np.int64).reshape(
            len(left), len(right)
        )
    return (left.astype(kind) @ right.astype(kind).T).astype(np.int64)


def _packed(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Blocks of rows of one vector length, sorted by id, as binary columns."""
    for batch in batches:
        sizes = batch.column(3).value_lengths().to_numpy(zero_copy_only=False)
        for size in np.unique(sizes):
            part = batch.filter(pa.array(sizes == size))
            part = part.take(pa.compute.sort_indices(part.column(0)))
            for at in range(0, part.num_rows, block):
                rows = part.slice(at, block)
                plain = [rows.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)]
                values = rows.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                small = values.astype(np.int16)
                if (small == values).all():
                    values = small
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([size], pa.int32()),
                        pa.array([rows.num_rows], pa.int32()),
                        *[pa.array([p.tobytes()], pa.binary()) for p in plain],
                        pa.array([values.tobytes()], pa.binary()),
                    ],
                    names=["size", "many", "ids", "labels", "marks", "vectors"],
                )


def _unpacked(block: pa.StructScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels, marks and vectors of a block; rows that repeat another are left out."""
    ids, labels, marks = [np.frombuffer(block[k].as_buffer(), np.int64) for k in ("ids", "labels", "marks")]
    many, size = block["many"].as_py(), block["size"].as_py()
    raw = block["vectors"].as_buffer()
    kind = np.int16 if raw.size == 2 * many * size else np.float64
    vectors = np.frombuffer(raw, kind).reshape(many, size).astype(np.float64)
    order = np.lexsort((marks, ids))
    fresh = np.r_[True, (np.diff(ids[order]) != 0) | (np.diff(marks[order]) != 0)]
    order = order[fresh[: len(order)]]
    return ids[order], labels[order], marks[order], vectors[order]


def _first(values: np.ndarray, allowed: np.ndarray, many: int) -> np.ndarray:
    """Whether a cell is among the ``many`` largest allowed ones of its row; of equals the earlier are first."""
    chosen = np.zeros(values.shape, bool)
    least = np.iinfo(np.int64).min
    left = np.where(allowed, values, least)
    rows = np.flatnonzero(allowed.any(axis=1))
    for _ in range(many):
        if not len(rows):
            break
        best = left[rows].argmax(axis=1) if len(rows) < len(left) else left.argmax(axis=1)
        rows, best = rows[allowed[rows, best]], best[allowed[rows, best]]
        chosen[rows, best] = True
        allowed[rows, best] = False
        left[rows, best] = least
    return chosen


class _Best:
    """The pairs of one group of anchors that can still count, over the blocks it has met."""

    def __init__(self, anchors: list[np.ndarray], windows: np.ndarray | None):
        self.ids, self.labels, self.marks, self.vectors = anchors
        self.windows = windows
        self.rows: list[np.ndarray] = [np.zeros((0, 5), np.int64)]

    def meet(self, block: list[np.ndarray]) -> None:
        """Add the first rows of a block for each anchor and purpose."""
        ids, labels, marks, vectors = block
        for label in np.unique(self.labels):
            own = np.flatnonzero(self.labels == label)
            other = np.flatnonzero((labels == label) == (self.windows is None))
            if not len(other):
                continue
            product = scores(self.vectors[own], vectors[other])
            chosen = self._chosen(own, product, ids[other])
            r, c = np.nonzero(chosen)
            c_all = other[c]
            self.rows.append(np.stack([own[r], product[r, c], ids[c_all], marks[c_all], labels[c_all]], 1))

    def _chosen(self, own: np.ndarray, product: np.ndarray, ids: np.ndarray) -> np.ndarray:
        strange = self.ids[own][:, None] != ids[None, :]
        if self.windows is None:
            return _first(product, strange, POSITIVES)
        chosen = np.zeros(product.shape, bool)
        for k in range(self.windows.shape[1]):
            low, high = self.windows[own, k, 0], self.windows[own, k, 1]
            inside = (product >= low[:, None]) & (product <= high[:, None]) & strange
            chosen |= _first(product, inside, NEGATIVES)
        return chosen

    def pairs(self) -> Iterator[pa.RecordBatch]:
        """What was kept, once per pair."""
        rows = np.concatenate(self.rows)
        if not len(rows):
            return
        self.rows = [rows[:0]]
        negative = np.full(len(rows), int(self.windows is not None), np.int32)
        columns = [self.ids[rows[:, 0]], self.marks[rows[:, 0]], rows[:, 1], negative, rows[:, 2], rows[:, 3]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in columns], names=["anchor", "place", "score", "negative", "id", "mark"]
        )

    def trim(self) -> None:
        """Keep of all blocks met what one block would hand on."""
        rows = np.concatenate(self.rows)
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]))]
        fresh = np.r_[True, (np.diff(rows[:, [0, 2, 3]], axis=0) != 0).any(axis=1)][: len(rows)]
        rows = rows[fresh]
        kept = np.zeros(len(rows), bool)
        if self.windows is None:
            kept |= _leading(rows[:, 0], np.ones(len(rows), bool), POSITIVES)
        else:
            for k in range(self.windows.shape[1]):
                low, high = self.windows[rows[:, 0], k, 0], self.windows[rows[:, 0], k, 1]
                kept |= _leading(rows[:, 0], (rows[:, 1] >= low) & (rows[:, 1] <= high), NEGATIVES)
        self.rows = [rows[kept]]


def _leading(group: np.ndarray, allowed: np.ndarray, many: int) -> np.ndarray:
    """The first ``many`` allowed rows of each run of equal groups."""
    before = np.cumsum(allowed) - allowed
    starts = np.flatnonzero(np.r_[True, np.diff(group) != 0][: len(group)])
    base = np.repeat(before[starts], np.diff(np.r_[starts, len(group)]))
    return allowed & (before - base < many)


def _windows(positives: np.ndarray) -> np.ndarray:
    """Least and greatest negative score per positive score; a missing one has an empty window."""
    out = np.empty((*positives.shape, 2), np.int64)
    for cell in np.ndindex(positives.shape):
        score = int(positives[cell])
        out[cell] = window(score) if score > np.iinfo(np.int64).min else (1, 0)
    return out


def window(score: int) -> tuple[int, int]:
    """The whole scores s with 50 * score <= 100 * s <= 95 * score."""
    low, high = WINDOW
    return -(-low * score // 100), high * score // 100


def _products(with_windows: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best = None, None
        for batch in batches:
            names = batch.schema.names
            for k in range(batch.num_rows):
                row = dict(zip(names, [c[k] for c in batch.columns], strict=True))
                key = row["key"].as_py()
                if best is None or key != now:
                    if best is not None:
                        yield from best.pairs()
                    anchors, windows = _anchor_block(row["anchors"], with_windows)
                    now, best = key, _Best(anchors, windows)
                best.meet(_unpacked(row["rows"]))
                best.trim()
        if best is not None:
            yield from best.pairs()

    return run


def _anchor_block(rows: pa.ListScalar, with_windows: bool) -> tuple[list[np.ndarray], np.ndarray | None]:
    listed = rows.values
    plain = [listed.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("id", "label", "mark")]
    vectors = listed.field("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    vectors = vectors.reshape(len(plain[0]), -1) if len(vectors) else np.zeros((len(plain[0]), 0))
    if not with_windows:
        return [*plain, vectors], None
    told = [list(x) for x in listed.field("positives").to_pylist()]
    scored = np.full((len(told), POSITIVES), np.iinfo(np.int64).min)
    for k, found in enumerate(told):
        scored[k, : len(found)] = found
    return [*plain, vectors], _windows(scored)


def _met(anchors: DataFrame, blocks: DataFrame, with_windows: bool) -> DataFrame:
    """Pairs that count, of every tile of anchors with every block of rows.

    A cell is a tile of anchors and a group of blocks; each is a unit of work of bounded
    size. A block goes once to each tile, a tile once to each group.
    """
    fields = ["id", "label", "mark", "vector", *(["positives"] if with_windows else [])]
    n_groups = -(-blocks.count() // GROUP) or 1
    n_tiles = -(-anchors.count() // TILE) or 1
    tasks = min(n_groups * n_tiles, _CELL_TASKS)
    cell = ["size", "tile", "deal"]
    tiles = (
        anchors.groupBy(
            F.size("vector").alias("size"), F.pmod(F.xxhash64("id", "mark"), F.lit(n_tiles)).cast("int").alias("tile")
        )
        .agg(F.collect_list(F.struct(*fields)).alias("anchors"))
        .withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
        .repartition(tasks, *cell)
    )
    rows = (
        blocks.select(
            "size",
            F.pmod(F.xxhash64("ids", "marks"), F.lit(n_groups)).cast("int").alias("deal"),
            F.struct("size", "many", "ids", "labels", "marks", "vectors").alias("rows"),
        )
        .withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1))))
        .repartition(tasks, *cell)
    )
    pairs = tiles.join(rows.hint("shuffle_merge"), cell)
    return pairs.select(F.concat_ws(":", *cell).alias("key"), "anchors", "rows").mapInArrow(
        _products(with_windows), _PAIR
    )


def _sorted_by_anchor(pairs: DataFrame) -> DataFrame:
    """Partitions of whole anchors, each sorted by anchor, descending score and id.

    At equal scores positives come first, so that their windows are open in time.
    """
    keys = ["anchor", "place", F.col("score").desc(), "negative", "id", "mark"]
    return pairs.repartition("anchor", "place").sortWithinPartitions(*keys)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads sorted pairs once; opens positive windows and emits their negatives."""
    now, last, opened, out = None, None, [], []
    for batch in batches:
        for anchor, place, score, negative, row_id, mark in zip(
            *[batch.column(k).to_pylist() for k in range(6)], strict=True
        ):
            if (anchor, place) != now:
                now, last, opened = (anchor, place), None, []
            if (score, negative, row_id, mark) == last:
                continue
            last = (score, negative, row_id, mark)
            if not negative:
                if len(opened) < POSITIVES:
                    opened.append([row_id, score, *window(score), 0])
                    out.append((anchor, place, row_id, score, 0, None, None))
                continue
            for held in opened:
                if held[2] <= score <= held[3] and held[4] < NEGATIVES:
                    held[4] += 1
                    out.append((anchor, place, held[0], held[1], held[4], row_id, score))
        if out:
            yield _emitted(out)
            out = []


_EMITTED = "anchor long, place long, positive_id long, positive_score long, rank int, negative_id long, negative_score long"


def _emitted(rows: list[tuple]) -> pa.RecordBatch:
    names = [field.split()[0] for field in _EMITTED.split(", ")]
    kinds = [pa.int32() if n == "rank" else pa.int64() for n in names]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names
    )


def mine(rows: DataFrame, is_anchor: Column, block: int = BLOCK) -> DataFrame:
    """Hard negatives of the rows that ``is_anchor`` picks: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has vec_id, label and embedding. A row's score is the inner product of the
    ``scaled`` vectors, an exact integer held to the range of a long. An anchor's positives are its first
    ``POSITIVES`` other rows of the same label by descending score, then vec_id. Each gets the first
    ``NEGATIVES`` rows of other labels whose score is in its ``window``; ``rank`` counts them from 1.

    Rows with a null id or label, a null vector or a null or non-finite component take no part.
    Vectors are scored against those of equal length only; an empty one scores zero. Rows that repeat id, label
    and vector count once; rows that share an id but differ are rows of their own, and none is
    positive or negative of an anchor with its id. Positives with a negative score have no window.
    A positive without negatives gives no row, nor does an empty table. Other columns are ignored.
    """
    kind = rows.schema["vec_id"].dataType.simpleString()
    kept = rows.where(F.col("vec_id").isNotNull() & usable()).select(
        F.col("vec_id").cast("long").alias("id"), "label", scaled().alias("vector"), is_anchor.alias("_anchor")
    )
    known = kept.select(
        "id",
        F.xxhash64("label").alias("label") if _is_text(rows) else F.col("label").cast("long").alias("label"),
        F.xxhash64("label", "vector").alias("mark"),
        "vector",
        "_anchor",
    )
    blocks = store(
        known.select("id", "label", "mark", "vector").mapInArrow(
            lambda batches: _packed(batches, block),
            "size int, many int, ids binary, labels binary, marks binary, vectors binary",
        )
    )
    anchors = store(known.where("_anchor").select("id", "label", "mark", "vector").distinct())
    first = store(_met(anchors, blocks, False))
    opened = _sorted_by_anchor(first).mapInArrow(_stream, _EMITTED)
    found = opened.groupBy("anchor", "place").agg(F.collect_list("positive_score").alias("positives"))
    with_positives = anchors.join(
        found.select(F.col("anchor").alias("id"), F.col("place").alias("mark"), "positives"), ["id", "mark"]
    )
    second = _met(store(with_positives), blocks, True)
    pairs = store(first.unionByName(second))
    return (
        _sorted_by_anchor(pairs)
        .mapInArrow(_stream, _EMITTED)
        .where("rank > 0")
        .select(
            F.col("anchor").cast(kind).alias("anchor_id"),
            F.col("positive_id").cast(kind).alias("positive_id"),
            "rank",
            F.col("negative_id").cast(kind).alias("negative_id"),
            "positive_score",
            "negative_score",
        )
    )


def _is_text(rows: DataFrame) -> bool:
    return rows.schema["label"].dataType.simpleString() in ("string", "binary", "boolean")
