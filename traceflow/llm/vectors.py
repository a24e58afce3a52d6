"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

A unit vector is ``s * q + e`` with an int8 vector ``q`` and a known length of
``e``. For two vectors the product of the quantised parts is off by at most
``|u_q| * |e_v| + |e_u| * |v_q| + |e_u| * |e_v|``. Pairs below the threshold by
more than that are settled by the tile product, as are those above by more; only
the rest is computed again in double precision. Links are counted and
contracted inside a tile product, so pairs are never written out.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceflow.llm.common import store
from traceflow.llm.components import components

THRESHOLD = 0.98
# Expected vectors of a tile.
TILE = 1024
# Pairs recomputed at once.
_EXACT_ROWS = 50_000
# Covers the rounding of the bound itself and of products in double precision.
_SLACK = 1e-9


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 parts, scales and error lengths of the unit vectors of the rows."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1) / 127
    parts = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - parts * scale[:, None], axis=1) + _SLACK
    return parts, scale, error


def _unit_norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", vectors, vectors))


def tile_links(
    left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], threshold: float = THRESHOLD
) -> tuple[np.ndarray, np.ndarray, int]:
    """Linked pairs (row of left, row of right) and how many were recomputed.

    Each side is (vectors, int8 parts, scales, errors).
    """
    a, qa, sa, ea = left
    b, qb, sb, eb = right
    # Sums of int8 products are exact in float32 below 2**24, that is up to 1040 dimensions.
    kind = np.float32 if qa.shape[1] <= 1040 else np.float64
    product = (qa.astype(kind) @ qb.astype(kind).T).astype(np.float64)
    product *= sa[:, None]
    product *= sb[None, :]
    bound = np.outer(1 + ea, eb) + np.outer(ea, 1 + eb) + np.outer(ea, eb) + _SLACK
    sure = product - bound >= threshold
    rows, cols = np.nonzero((product + bound >= threshold) & ~sure)
    norm_a, norm_b = _unit_norms(a), _unit_norms(b)
    keep = np.zeros(len(rows), bool)
    for at in range(0, len(rows), _EXACT_ROWS):
        r, c = rows[at : at + _EXACT_ROWS], cols[at : at + _EXACT_ROWS]
        keep[at : at + _EXACT_ROWS] = (
            np.einsum("ij,ij->i", a[r], b[c]) / (norm_a[r] * norm_b[c]) >= threshold
        )
    sure[rows[keep], cols[keep]] = True
    found = np.nonzero(sure)
    return found[0], found[1], len(rows)


def _matrix(tile: pa.Scalar) -> tuple[np.ndarray, ...]:
    """ids, members and (vectors, parts, scales, errors) of a tile."""
    rows = tile.values
    field = {name: rows.field(name) for name in ("id", "members", "vector", "parts", "scale", "error")}
    many = len(rows)
    vectors = np.frombuffer(b"".join(field["vector"].to_pylist()), np.float64).reshape(many, -1)
    parts = np.frombuffer(b"".join(field["parts"].to_pylist()), np.int8).reshape(many, -1)
    plain = [field[n].to_numpy(zero_copy_only=False) for n in ("id", "members", "scale", "error")]
    return plain[0], plain[1], (vectors, parts, plain[2], plain[3])


def _least_reachable(ids_a: np.ndarray, ids_b: np.ndarray, rows: np.ndarray, cols: np.ndarray):
    """Least id reachable from each linked row over the links of this product alone."""
    least_a, least_b = ids_a.copy(), ids_b.copy()
    while True:
        before = least_a.copy(), least_b.copy()
        np.minimum.at(least_a, rows, least_b[cols])
        np.minimum.at(least_b, cols, least_a[rows])
        if (least_a == before[0]).all() and (least_b == before[1]).all():
            return least_a, least_b


def _products(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                same = batch.column(0)[k].as_py()
                ids_a, members_a, left = _matrix(batch.column(1)[k])
                ids_b, members_b, right = _matrix(batch.column(2)[k])
                rows, cols, exact = tile_links(left, right, threshold)
                if same:
                    other = rows != cols
                    rows, cols = rows[other], cols[other]
                if not len(rows):
                    continue
                least_a, least_b = _least_reachable(ids_a, ids_b, rows, cols)
                sides = [(ids_a, np.bincount(rows, members_b[cols], len(ids_a)), least_a)]
                if not same:
                    sides.append((ids_b, np.bincount(cols, members_a[rows], len(ids_b)), least_b))
                for ids, links, least in sides:
                    has = links > 0
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids[has], pa.int64()),
                            pa.array(links[has].astype(np.int64)),
                            pa.array(least[has], pa.int64()),
                        ],
                        names=["id", "links", "least"],
                    )

    return run


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds int8 parts, scale and error; rows come with equal lengths or are split by length."""
    for batch in batches:
        lists = batch.column(3)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        for size in np.unique(sizes):
            part = batch.filter(pa.array(sizes == size))
            values = part.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            vectors = values.reshape(part.num_rows, size)
            # Scaling by a power of two is exact and keeps squares in range.
            top = np.abs(vectors).max(axis=1, keepdims=True)
            vectors = np.ldexp(vectors, -np.frexp(top)[1])
            parts, scale, error = quantise(vectors)
            yield pa.RecordBatch.from_arrays(
                [
                    *part.columns[:3],
                    pa.array(np.full(part.num_rows, size), pa.int32()),
                    pa.array([v.tobytes() for v in vectors], pa.binary()),
                    pa.array([p.tobytes() for p in parts], pa.binary()),
                    pa.array(scale),
                    pa.array(error),
                ],
                names=["label", "id", "members", "size", "vector", "parts", "scale", "error"],
            )


def near_duplicates(
    rows: DataFrame, threshold: float = THRESHOLD, tile: int = TILE
) -> DataFrame:
    """One row per row of ``rows``: vec_id, n_links, component_id, kept.

    Vectors (vec_id, embedding, label) link when their labels are equal and not
    null and their cosine is at least ``threshold``. Vectors that are null,
    empty, zero or hold a null or non-finite number, and vectors of different
    lengths, do not link. Equal vectors are one class with its members counted, so copies cost
    nothing more. A label is cut into tiles by a hash of the id, as many as its
    classes need, and each pair of tiles is a row of its own, whatever the
    share of the label. Rows that repeat a vec_id count as vectors; a null
    vec_id is nobody's component and not kept. Other columns are ignored.
    """
    numbers = rows.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = ~F.exists(
        "embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    ) & F.exists("embedding", lambda x: x != 0)
    valid = numbers.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
    classes = store(
        valid.groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("members"))
        .where("id is not null")
    )
    label_kind = rows.schema["label"].dataType.simpleString()
    measured = classes.select("label", "id", "members", "embedding").mapInArrow(
        _quantised,
        f"label {label_kind}, id long, members long, size int, vector binary, parts binary, scale double, error double",
    )
    sizes = classes.groupBy("label", F.size("embedding").alias("size")).agg(
        F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles")
    )
    vector = F.struct("id", "members", "vector", "parts", "scale", "error")
    tiles = store(
        measured.join(sizes, ["label", "size"])
        .groupBy("label", "size", "tiles", F.pmod(F.xxhash64("id"), "tiles").cast("int").alias("tile"))
        .agg(F.collect_list(vector).alias("rows"))
    )
    partners = tiles.select(
        "label", "size", F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("other"), F.col("tile").alias("own"), F.col("rows").alias("left")
    )
    other = tiles.select("label", "size", F.col("tile").alias("other"), F.col("rows").alias("right"))
    pairs = partners.join(other, ["label", "size", "other"]).select(
        (F.col("own") == F.col("other")).alias("same"), "left", "right"
    )
    found = store(pairs.mapInArrow(_products(threshold), "id long, links long, least long"))
    counts = found.groupBy("id").agg(F.sum("links").alias("_links"))
    parts = components(found.select(F.col("id").alias("u"), F.col("least").alias("v")))
    answers = (
        classes.join(counts, "id", "left")
        .join(parts.select(F.col("node").alias("id"), "component"), "id", "left")
        .select(
            "label",
            "embedding",
            (F.coalesce("_links", F.lit(0)) + F.col("members") - 1).alias("_links"),
            F.coalesce("component", "id").alias("_component"),
        )
    )
    linked = valid.join(answers, ["label", "embedding"], "left")
    alone = numbers.where(
        ~(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
    )
    result = linked.select("vec_id", "_links", "_component").unionByName(
        alone.select("vec_id", F.lit(0).cast("long").alias("_links"), F.col("vec_id").alias("_component"))
    )
    component = F.coalesce("_component", "vec_id")
    return result.select(
        "vec_id",
        F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
