"""Repeated byte strings by a distributed difference-cover suffix sort, to the depth that matters.

Only prefixes of ``LENGTH`` bytes have to be compared, so suffixes are ordered
to that depth and not further:

1. *Sort sampled tuples.* Samples are the positions that fall on a difference
   cover D modulo 7. Whatever the places of two equal strings of 50 bytes, some
   offset below 7 puts both on D, where at least 44 more bytes agree. Each sample
   is named by a hash of its 44 bytes; names are dealt to buckets and sorted. A
   name found in one document only is unique and leaves.
2. *Recurse on names, merge the remaining suffixes.* What is left are the
   positions within reach of a surviving sample. Their order to 50 bytes needs
   no deeper recursion: each is named by its 50 bytes, dealt to buckets and sorted.
3. *Compare adjacent prefixes.* Equal neighbours in a bucket are compared by
   doc_id; a string that also starts in a smaller document is repeated and its
   bytes go. Whole copies of a smaller document are known from their digests
   and are left out of step 2.

Texts are packed into slabs by a hash of doc_id and written once, bucketed by
slab, so replies come back to the texts without moving them. A slab sends each
of its names once, in packed arrays, so a passage that a third of all documents
share weighs no more than one entry per slab.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceflow.llm.common import store, store_bucketed, utf8

LENGTH = 50
PERIOD = 7
COVER = (0, 1, 3)
TUPLE = LENGTH - PERIOD + 1
# Bytes of text in a slab, slabs in a file, and bytes of all text per bucket of names.
SLAB_BYTES = 2_000_000
SLABS_PER_FILE = 16
BUCKET_BYTES = 16_000_000

# Positions hashed at once, and flags of a lookup by low bits.
_BLOCK = 16384
_LOW_BITS = 1 << 22

_ON_COVER = np.isin(np.arange(PERIOD), COVER)
_NAMES = "slab int, bucket int, names binary, marks binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one slab follow each other; one slab is held at a time."""

    def slab(number: int, ids: list[int], texts: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int32()),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([[len(t) for t in texts]], pa.list_(pa.int32())),
                pa.array([b"".join(texts)], pa.binary()),
            ],
            names=["slab", "ids", "sizes", "data"],
        )

    ids: list[int] = []
    texts: list[bytes] = []
    number = None
    for batch in batches:
        for own, key, text in zip(*batch.columns, strict=True):
            if own.as_py() != number:
                if ids:
                    yield slab(number, ids, texts)
                ids, texts, number = [], [], own.as_py()
            ids.append(key.as_py())
            texts.append(text.as_py() or b"")
    if ids:
        yield slab(number, ids, texts)


def _slabs(docs: DataFrame, total: int) -> tuple[DataFrame, int]:
    """(slab, ids, sizes, data), bucketed by slab, and the number of slabs."""
    files = max(1, -(-total // (SLAB_BYTES * SLABS_PER_FILE)))
    count = files * SLABS_PER_FILE
    slab = F.pmod(F.xxhash64("doc_id"), F.lit(count)).cast("int").alias("slab")
    rows = docs.select(slab, "doc_id", utf8("text").alias("text"))
    packed = (
        rows.repartition(files, "slab")
        .sortWithinPartitions("slab", "doc_id")
        .mapInArrow(_pack, "slab int, ids array<long>, sizes array<int>, data binary")
    )
    return store_bucketed(packed, "slab", files), count


class Slab:
    """The bytes of a slab with the document of each position."""

    def __init__(self, ids: list[int], sizes: list[int], data: bytes):
        self.ids, self.sizes, self.data = np.array(ids, np.int64), np.array(sizes, np.int64), data
        self.starts = np.cumsum(self.sizes) - self.sizes
        padded = data + b"\0" * 64
        self._words = np.ndarray((len(data) + 56,), "<u8", buffer=padded, strides=(1,))

    def inside(self) -> np.ndarray:
        """Offset of each position in its document."""
        return np.arange(len(self.data)) - np.repeat(self.starts, self.sizes)

    def room(self, inside: np.ndarray) -> np.ndarray:
        """Bytes from each position to the end of its document."""
        return np.repeat(self.sizes, self.sizes) - inside

    def document(self, at: np.ndarray) -> np.ndarray:
        # A document without bytes owns no position: the last start at or before it is meant.
        return self.ids[np.searchsorted(self.starts, at, side="right") - 1]

    def hashed(self, at: np.ndarray, length: int, seed: int) -> np.ndarray:
        """A hash of the bytes from each of the ascending positions on, block by block to stay in the cache."""
        hashes = np.empty(len(at), np.uint64)
        for begin in range(0, len(at), _BLOCK):
            near, out = at[begin : begin + _BLOCK], hashes[begin : begin + _BLOCK]
            words = self._words[near[0] : near[-1] + length - 7]
            # Copied where it is small: numbers at odd addresses are slow to pick.
            if len(words) <= 8 * _BLOCK:
                words = words.copy()
            place, out[:] = near - near[0], seed
            for offset in [*range(0, length - 8, 8), length - 8]:
                out ^= words[place + offset]
                out *= np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(29)
                out *= np.uint64(0xBF58476D1CE4E5B9)
                out ^= out >> np.uint64(32)
        return hashes


class Names:
    """The distinct names of some positions, sorted by bucket and name."""

    def __init__(self, bucket: np.ndarray, name: np.ndarray, buckets: int):
        by_name = np.argsort(name)
        # Numbers of 16 bits are sorted in linear time.
        small = bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket
        self.order = by_name[np.argsort(small[by_name], kind="stable")]
        b, n = bucket[self.order], name[self.order]
        first = np.r_[True, (b[1:] != b[:-1]) | (n[1:] != n[:-1])] if len(b) else np.zeros(0, bool)
        self.heads = np.flatnonzero(first)
        self.names = n[self.heads]
        self.cuts = np.searchsorted(b[self.heads], np.arange(buckets + 1))
        self._group = np.cumsum(first) - 1

    def least(self, values: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(values[self.order], self.heads) if len(self.heads) else values[:0]

    def spread(self, per_name: np.ndarray) -> np.ndarray:
        """A value per name back to the positions."""
        out = np.empty(len(self.order), per_name.dtype)
        out[self.order] = per_name[self._group]
        return out


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of the values are in a sorted array; most that are not are told by their low bits."""
    low = np.uint64(_LOW_BITS - 1)
    seen = np.zeros(_LOW_BITS, bool)
    seen[(ordered & low).view(np.int64)] = True
    found = seen[(values & low).view(np.int64)]
    at = np.flatnonzero(found)
    if len(at):
        asked = values[at]
        found[at] = ordered[np.minimum(np.searchsorted(ordered, asked), len(ordered) - 1)] == asked
    return found


class SampleNames:
    """The distinct names of the samples of a slab, sorted by bucket and name.

    Bucket and name of 32 bits each are one number, so the numbers are sorted
    without the positions; only the positions of names in question are looked up.
    """

    def __init__(self, slab: Slab, buckets: int):
        inside = slab.inside()
        self.at = np.flatnonzero(_ON_COVER[inside % PERIOD] & (slab.room(inside) >= TUPLE))
        h = slab.hashed(self.at, TUPLE, 1)
        self._key = (h >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)
        ordered = np.sort(self._key)
        heads = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
        self._distinct = ordered[heads]
        self._counts = np.diff(np.r_[heads, len(ordered)])
        self.names = self._distinct.astype(np.uint32)
        self.cuts = np.searchsorted(self._distinct, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))

    def several(self, slab: Slab) -> np.ndarray:
        """Whether each name is found in more than one document of the slab."""
        out = self._counts > 1
        again = np.flatnonzero(_among(self._key, self._distinct[out]))
        if len(again):
            again = again[np.argsort(self._key[again])]
            heads = np.flatnonzero(np.r_[True, self._key[again[1:]] != self._key[again[:-1]]])
            owner = slab.document(self.at[again])
            out[out] = np.minimum.reduceat(owner, heads) < np.maximum.reduceat(owner, heads)
        return out

    def positions(self, picked: np.ndarray) -> np.ndarray:
        """The positions of the picked names."""
        return self.at[_among(self._key, self._distinct[picked])]


def _strings(slab: Slab, at: np.ndarray, buckets: int) -> Names:
    bucket = slab.hashed(at, LENGTH, 2) % np.uint64(buckets)
    return Names(bucket.astype(np.int32), slab.hashed(at, LENGTH, 3), buckets)


def _rows(slab: int, names: Names | SampleNames, marks) -> pa.RecordBatch:
    """Packed names, one row per bucket."""
    full = np.flatnonzero(np.diff(names.cuts))
    ranges = [(names.cuts[b], names.cuts[b + 1]) for b in full]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([slab] * len(full), pa.int32()),
            pa.array(full, pa.int32()),
            pa.array([names.names[a:b].tobytes() for a, b in ranges], pa.binary()),
            pa.array([marks(a, b) for a, b in ranges], pa.binary()),
        ],
        names=["slab", "bucket", "names", "marks"],
    )


def _planes(values: np.ndarray) -> bytes:
    """64-bit values byte plane by byte plane, so that planes of zeros compress to nothing."""
    return values.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _each_slab(batch: pa.RecordBatch) -> Iterator[tuple[int, Slab, list[dict]]]:
    for i in range(batch.num_rows):
        number, ids, sizes, data = (batch.column(c)[i].as_py() for c in range(4))
        replies = batch.column(4)[i].as_py() if batch.num_columns > 4 else []
        yield number, Slab(ids, sizes, data), sorted(replies or [], key=lambda r: r["bucket"])


def _send_samples(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, slab, _ in _each_slab(batch):
                names = SampleNames(slab, buckets)
                several = names.several(slab)
                yield _rows(number, names, lambda a, b, s=several: np.packbits(s[a:b]).tobytes())

    return run


def _survivors(group: pa.Table) -> pa.Table:
    """Bits of the names that two slabs send or one slab has in several documents."""
    parts = [np.frombuffer(x, np.uint32) for x in group.column("names").to_pylist()]
    sizes = [len(p) for p in parts]
    names = np.concatenate(parts).astype(np.uint64)
    marks = group.column("marks").to_pylist()
    several = np.concatenate(
        [np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(marks, sizes, strict=True)]
    ).astype(bool)
    ordered = np.sort(names)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    stays = _among(names, np.unique(np.r_[twice, names[several]]))
    cuts = np.cumsum(sizes)[:-1]
    return _answers(group, [np.packbits(x).tobytes() for x in np.split(stays, cuts)])


def _in_smaller(group: pa.Table) -> pa.Table:
    """Bits of the names that another slab has in a smaller document than any of the sender's."""
    parts = [np.frombuffer(x, np.uint64) for x in group.column("names").to_pylist()]
    owners = np.concatenate([_from_planes(x) for x in group.column("marks").to_pylist()])
    names = np.concatenate(parts)
    order = np.argsort(names)
    ordered = names[order]
    heads = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    least = np.minimum.reduceat(owners[order], heads)
    found = np.empty(len(names), bool)
    found[order] = np.repeat(least, np.diff(np.r_[heads, len(names)])) < owners[order]
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    return _answers(group, [np.packbits(x).tobytes() for x in np.split(found, cuts)])


def _answers(group: pa.Table, answers: list[bytes]) -> pa.Table:
    return pa.table(
        {
            "slab": group.column("slab"),
            "bucket": group.column("bucket"),
            "answer": pa.array(answers, pa.binary()),
        }
    )


def _runs(mask: np.ndarray) -> np.ndarray:
    """[start, end) of the runs of a mask, one per row."""
    edges = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return edges.reshape(-1, 2)


def _bits(names: Names | SampleNames, replies: list[dict]) -> np.ndarray:
    """The replies of the buckets as one flag per name."""
    out = np.zeros(len(names.names), bool)
    for r in replies:
        a, b = names.cuts[r["bucket"]], names.cuts[r["bucket"] + 1]
        out[a:b] = np.unpackbits(np.frombuffer(r["answer"], np.uint8), count=b - a)
    return out


def _candidates(slab: Slab, replies: list[dict], copied: np.ndarray, buckets: int) -> np.ndarray:
    """Starts of strings that reach a surviving sample within a period, whole copies left out."""
    names = SampleNames(slab, buckets)
    hit = names.positions(_bits(names, replies))
    inside = slab.inside()
    change = np.zeros(len(slab.data) + 1, np.int32)
    np.add.at(change, hit - np.minimum(inside[hit], PERIOD - 1), 1)
    np.add.at(change, hit + 1, -1)
    own = np.repeat(~copied, slab.sizes)
    return np.flatnonzero((np.cumsum(change)[:-1] > 0) & (slab.room(inside) >= LENGTH) & own)


_COPY = np.dtype([("id", ">i8"), ("digest", ">u8")])


def _copied(slab: Slab, replies: list[dict]) -> np.ndarray:
    """Whether each document is a whole copy; their reply, ids with the first bytes of digests, has bucket -1.

    Another text under the id of a copy is none.
    """
    told = np.frombuffer(b"".join(r["answer"] for r in replies if r["bucket"] == -1), _COPY)
    found = np.isin(slab.ids, told["id"])
    known = set(told.tolist())
    for k in np.flatnonzero(found):
        text = slab.data[slab.starts[k] : slab.starts[k] + slab.sizes[k]]
        digest = int.from_bytes(hashlib.sha256(text).digest()[:8], "big")
        found[k] = (int(slab.ids[k]), digest) in known
    return found


def _send_strings(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, slab, replies in _each_slab(batch):
                first = [r for r in replies if 0 <= r["bucket"] < buckets]
                at = _candidates(slab, first, _copied(slab, replies), buckets)
                names = _strings(slab, at, buckets)
                least = names.least(slab.document(at)) if len(at) else np.zeros(0, np.int64)
                yield _rows(number, names, lambda a, b, x=least: _planes(x[a:b]))

    return run


def _cut(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, slab, replies in _each_slab(batch):
                first = [r for r in replies if 0 <= r["bucket"] < buckets]
                # Replies to the strings come with bucket numbers above those to the samples.
                second = [r | {"bucket": r["bucket"] - buckets} for r in replies if r["bucket"] >= buckets]
                copied = _copied(slab, replies)
                at = _candidates(slab, first, copied, buckets)
                change = np.zeros(len(slab.data) + 1, np.int32)
                if len(at):
                    names = _strings(slab, at, buckets)
                    owner = slab.document(at)
                    found = at[names.spread(_bits(names, second)) | (names.spread(names.least(owner)) < owner)]
                    np.add.at(change, found, 1)
                    np.add.at(change, found + LENGTH, -1)
                gone = np.cumsum(change)[:-1] > 0
                gone |= np.repeat(copied & (slab.sizes >= LENGTH), slab.sizes)
                data = np.frombuffer(slab.data, np.uint8)
                counts, spans, kept = [], [], []
                for a, n in zip(slab.starts.tolist(), slab.sizes.tolist(), strict=True):
                    own = gone[a : a + n]
                    counts.append(int(own.sum()))
                    spans.append([{"start": int(x), "end": int(y)} for x, y in _runs(own)] if counts[-1] else [])
                    kept.append(data[a : a + n][~own].tobytes() if counts[-1] else slab.data[a : a + n])
                span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(slab.ids),
                        pa.array(slab.sizes),
                        pa.array(counts, pa.int64()),
                        pa.array(spans, span),
                        pa.array(kept, pa.binary()),
                    ],
                    names=["doc_id", "n_bytes", "n_removed", "spans", "kept"],
                )

    return run


_RESULT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept binary"


def remove_repeated(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, spans, kept.

    Each byte covered by a 50-byte string that also starts in a document with a
    smaller doc_id is removed; strings do not cross documents and are judged on
    the input. ``spans`` are the maximal removed byte ranges, ``kept`` the other
    bytes. A null text is empty. A row without a doc_id loses nothing and is
    nobody's source; rows that repeat a doc_id are not sources of each other, and each is judged by its own text.
    Texts are UTF-8 bytes, whole; one text has to fit in a task. Other columns
    are ignored. Strings are told apart by 64 hashed bits besides those that
    choose the bucket.
    """
    named = docs.where("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long"))
    digests = store(
        named.select("doc_id", F.unhex(F.sha2(utf8("text"), 256)).alias("digest"), F.octet_length(utf8("text")).alias("bytes"))
    )
    total = digests.agg(F.sum(F.col("bytes").cast("long"))).first()[0] or 0
    buckets = max(8, -(-total // BUCKET_BYTES))
    texts, count = _slabs(named, total)
    originals = digests.where(F.col("bytes") >= LENGTH).groupBy("digest").agg(
        F.min("doc_id").alias("_original"), F.count(F.lit(1)).alias("_n")
    )
    copied = digests.join(originals.where("_n > 1"), "digest").where("doc_id > _original")
    # Ids and heads of digests as eight big-endian bytes each, those of a slab in one reply.
    both = F.concat(F.lpad(F.hex("doc_id"), 16, "0"), F.substring(F.hex("digest"), 1, 16)).alias("both")
    copies = store(
        copied.select(F.pmod(F.xxhash64("doc_id"), F.lit(count)).cast("int").alias("slab"), both)
        .distinct()
        .groupBy("slab")
        .agg(F.array_join(F.array_sort(F.collect_list("both")), "").alias("ids"))
        .select("slab", F.lit(-1).alias("bucket"), F.unhex("ids").alias("answer"))
    )
    answer = "slab int, bucket int, answer binary"

    def reply(rows: DataFrame, decide) -> DataFrame:
        return store(rows.groupBy("bucket").applyInArrow(decide, answer))

    def with_replies(replies: DataFrame) -> DataFrame:
        one = F.struct("bucket", "answer")
        # Written, so that its partitioning is none and only it is moved to the buckets of the texts.
        gathered = store(replies.groupBy("slab").agg(F.collect_list(one).alias("replies")))
        return texts.join(gathered.hint("merge"), "slab", "left").select("slab", "ids", "sizes", "data", "replies")

    first = reply(texts.mapInArrow(_send_samples(buckets), _NAMES), _survivors).unionByName(copies)
    second = reply(with_replies(first).mapInArrow(_send_strings(buckets), _NAMES), _in_smaller)
    shifted = second.withColumn("bucket", F.col("bucket") + F.lit(buckets))
    done = with_replies(first.unionByName(shifted)).mapInArrow(_cut(buckets), _RESULT)
    whole = F.coalesce(utf8("text"), F.lit(b""))
    size = F.octet_length(whole).cast("long")
    nameless = docs.where("doc_id is null").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        size.alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"),
        F.array().cast("array<struct<start:int,end:int>>").alias("spans"),
        whole.alias("kept"),
    )
    return done.unionByName(nameless)
