"""Fuzzy repeated passages by seeds, collinear chaining and alignment.

1. Seeds: hashes of k words, thinned to window minimisers, so two runs of
   ``k + window - 1`` equal words share a seed. Short seeds (5 words) tolerate edits;
   long ones make sure that an exact run of 50 words has a seed of its own.
2. Each seed is joined with its first occurrence, in the smallest doc_id.
3. Per pair of documents, anchors in order in both are chained by a Fenwick
   tree over positions in the earlier document, less a cost per gap.
4. Chains are aligned word by word; stretches of at least 50 words and 80 %
   equal words are passages. They stay in the earlier document only.
5. Exact passages do not depend on which document a seed was seen in first: a run
   of 50 words has a long seed, so the hashes of all windows of 50 words around
   repeated long seeds are joined with the least doc_id that has them.
"""

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceflow.llm.common import store, utf8

MIN_WORDS = 50
SIMILARITY = 0.8
# (words of a seed, k-mers of a minimiser window)
SEEDS = ((5, 10), (24, 27))
# Bytes between two anchors of a chain at most, and bytes of context cut around a chain.
MAX_GAP = 500
CONTEXT = 1000
_GAP_COST = 0.05

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
# Rows handed on at once, and bytes of text hashed at once.
_ROWS = 256
_SLAB = 1_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MULTIPLIER
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_power_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_power_tables.get(base, ())) < n:
        # Doubled sizes, so the table is not made anew for every slab.
        out = np.full(1 << max(16, n.bit_length()), base, np.uint64)
        out[0] = 1
        _power_tables[base] = np.multiply.accumulate(out)
    return _power_tables[base][:n]


def _range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each range that does not depend on its place."""
    n = len(values) + 1
    sums = np.zeros(n, np.uint64)
    np.cumsum(values * _powers(_BASE, n)[:-1], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * _powers(_BASE_INVERSE, n)[starts])


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over x[i : i + width] for every i that has a whole window."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def seeds_of(texts: list[bytes], kinds=SEEDS) -> Iterator[tuple[np.ndarray, ...]]:
    """Per kind of seed: (hash, text number, byte start, byte end, is first in its text)."""
    sizes = np.array([len(t) for t in texts])
    starts_of = np.cumsum(sizes + 1) - sizes
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    space = _IS_SPACE[data]
    edges = np.diff(space.astype(np.int8))
    begin, end = np.flatnonzero(edges == -1) + 1, np.flatnonzero(edges == 1) + 1
    if not len(begin):
        return
    word = _range_hash(_LOWER[data].astype(np.uint64) + np.uint64(1), begin, end)
    owner = np.searchsorted(starts_of, begin, side="right") - 1
    for k, window in kinds:
        many = len(word) - k + 1
        if many <= 0:
            continue
        at = np.arange(many)
        hashed = _range_hash(word, at, at + k) & np.uint64(0x7FFFFFFFFFFFFFFF)
        whole = owner[:many] == owner[k - 1 :]
        # Windows that run over the end of a text must see nothing of the next one.
        place = at + owner[:many] * window + window
        laid = np.full(len(word) + (len(texts) + 2) * window, _NONE)
        laid[place[whole]] = hashed[whole]
        least = _slide(laid, window, np.minimum)
        # A window without any k-mer must not count as the largest.
        least = np.where(least == _NONE, np.uint64(0), least)
        best = _slide(least, window, np.maximum)
        chosen = at[whole][best[place[whole] - window + 1] == hashed[whole]]
        h, o = hashed[chosen], owner[chosen]
        order = np.lexsort((chosen, h, o))
        ho, oo = h[order], o[order]
        first = np.ones(len(order), bool)
        first[order[1:]] = (ho[1:] != ho[:-1]) | (oo[1:] != oo[:-1])
        base = starts_of[o]
        # The lowest bit tells long seeds from the others.
        seed = h & ~np.uint64(1) | np.uint64(k == SEEDS[-1][0])
        yield seed.view(np.int64), o, begin[chosen] - base, end[chosen + k - 1] - base, first


def _seed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        texts, numbers, held = [], [], 0
        for i, scalar in enumerate(batch.column(1)):
            texts.append(scalar.as_py())
            numbers.append(i)
            held += len(texts[-1])
            if held >= _SLAB or i + 1 == batch.num_rows:
                for h, o, a, b, first in seeds_of(texts):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(h),
                            ids.take(pa.array(np.array(numbers)[o])),
                            pa.array(a.astype(np.int32)),
                            pa.array(b.astype(np.int32)),
                            pa.array(first),
                        ],
                        names=["seed", "doc_id", "start", "end", "first"],
                    )
                texts, numbers, held = [], [], 0


def _anchors(docs: DataFrame) -> DataFrame:
    """Seeds of each document next to their first occurrence in an earlier one.

    ``long`` tells long seeds; those that repeat are also next to themselves in their first document.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", utf8("text").alias("text")).where("doc_id is not null and text is not null")
    seeds = rows.mapInArrow(_seed_batches, f"seed long, doc_id {kind}, start int, end int, first boolean")
    owner = F.when(F.col("first"), F.col("doc_id"))
    source = seeds.groupBy("seed").agg(
        F.min("doc_id").alias("source"),
        F.max("doc_id").alias("_last"),
        F.min_by("start", owner).alias("source_start"),
        F.min_by("end", owner).alias("source_end"),
    )
    # Written first: few seeds repeat, and the shuffle of all seeds is over before the next one.
    source = store(source.where("source < _last").drop("_last"))
    long = F.col("seed").bitwiseAND(F.lit(1)) == 1
    return (
        seeds.drop("first")
        .join(source, "seed")
        .where((F.col("doc_id") > F.col("source")) | (F.col("doc_id") == F.col("source")) & long)
        .select("doc_id", "source", "start", "end", "source_start", "source_end", long.alias("long"))
    )


def _word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(byte start, hash) of each word."""
    data = _LOWER[np.frombuffer(b" " + text + b" ", np.uint8)]
    edges = np.diff(_IS_SPACE[data].astype(np.int8))
    begin, end = np.flatnonzero(edges == -1) + 1, np.flatnonzero(edges == 1) + 1
    return begin - 1, _range_hash(data.astype(np.uint64) + np.uint64(1), begin, end)


def windows_of(text: bytes, starts: np.ndarray, length: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of the windows of ``length`` words with a long seed at one of the bytes ``starts``."""
    begins, word = _word_hashes(text)
    many = len(begins) - length + 1
    if many <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    seen = np.searchsorted(begins, np.unique(starts))
    edges = np.zeros(max(len(begins), int(seen.max(initial=0))) + 2, np.int64)
    np.add.at(edges, np.maximum(seen - (length - SEEDS[-1][0]), 0), 1)
    np.add.at(edges, seen + 1, -1)
    at = np.flatnonzero(np.cumsum(edges)[:many] > 0)
    return _range_hash(word, at, at + length).view(np.int64), at.astype(np.int32)


def _window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            starts = batch.column(2)[i].values.to_numpy()
            hashed, at = windows_of(batch.column(1)[i].as_py(), starts)
            ids = batch.column(0).take(pa.array(np.full(len(at), i)))
            yield pa.RecordBatch.from_arrays([pa.array(hashed), ids, pa.array(at)], names=["window", "doc_id", "at"])


def _exact_windows(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(_exact_doc, _windows): places of the windows of 50 words that an earlier document has, with the first one.

    ``marks`` has (doc_id, _starts): the long seeds of each document that more than one doc_id has.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", utf8("text").alias("text")).where("doc_id is not null and text is not null")
    windows = store(
        rows.join(marks, "doc_id")
        .select("doc_id", "text", "_starts")
        .mapInArrow(_window_batches, f"window long, doc_id {kind}, at int")
    )
    first = windows.groupBy("window").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("_last"))
    first = store(first.where("source < _last").drop("_last"))
    found = windows.join(first, "window").where("doc_id > source")
    return store(
        found.groupBy(F.col("doc_id").alias("_exact_doc")).agg(F.collect_list(F.struct("at", "window", "source")).alias("_windows"))
    )


def exact_ranges(text: bytes, windows: pa.StructArray, gone: np.ndarray) -> list[tuple[int, int, int]]:
    """Passages of repeated windows in a row with one source, but for those of which all words are gone."""
    _, word = _word_hashes(text)
    at, hashed = (windows.field(c).to_numpy() for c in (0, 1))
    # Another row of this doc_id may have a window here that this text does not have.
    fits = np.flatnonzero(at + MIN_WORDS <= len(word))
    own = _range_hash(word, at[fits], at[fits] + MIN_WORDS).view(np.int64) == hashed[fits]
    fits = fits[own]
    # One window of this text and so one source at each place, though rows that repeat may name it again.
    places, one = np.unique(at[fits], return_index=True)
    if not len(places):
        return []
    sources = windows.field(2).take(pa.array(fits[one]))
    of = sources.dictionary_encode().indices.to_numpy()
    cuts = np.flatnonzero((np.diff(places) != 1) | (of[1:] != of[:-1])) + 1
    begins, ends = [0, *cuts.tolist()], [*(cuts - 1).tolist(), len(places) - 1]
    runs = [(int(places[i]), int(places[j]) + MIN_WORDS, sources[i].as_py()) for i, j in zip(begins, ends, strict=True)]
    return [(a, b, s) for a, b, s in runs if not gone[a:b].all()]


def chains_of(anchors: list[tuple[int, int, int, int]], max_gap: int = MAX_GAP) -> list[list[int]]:
    """Chains (lists of anchor numbers) of the anchors (start, end, source start, source end) of one pair.

    The score of a chain is the length of its anchors less a cost per byte of
    gap in both texts. A Fenwick tree over the source positions holds the best
    chain that ends before a position. Chains are taken best first; a link over
    more than ``max_gap`` bytes cuts a chain.
    """
    order = sorted(range(len(anchors)), key=lambda i: (anchors[i][0], -anchors[i][2]))
    places = [anchors[i][2] for i in order]
    starts = [anchors[i][0] for i in order]
    if all(x < y for x, y in pairwise(places)) and all(x < y for x, y in pairwise(starts)):
        # In order in both texts: each anchor goes on from the one before, or starts anew.
        held, chains = 0.0, []
        for before, i in zip([None, *order], order, strict=False):
            if before is None:
                chains.append([i])
            else:
                gap = anchors[i][0] - anchors[before][0] + anchors[i][2] - anchors[before][2]
                held -= _GAP_COST * gap
                near = max(anchors[i][0] - anchors[before][1], anchors[i][2] - anchors[before][3]) <= max_gap
                if held > 0 and near:
                    chains[-1].append(i)
                else:
                    held = 0.0
                    chains.append([i])
            held += anchors[i][1] - anchors[i][0]
        return chains
    ranks = {b: r + 1 for r, b in enumerate(sorted({a[2] for a in anchors}))}
    best_score = [0.0] * (len(ranks) + 1)
    best_from = [-1] * (len(ranks) + 1)
    score, back = [0.0] * len(anchors), [-1] * len(anchors)
    cost = _GAP_COST
    for i in order:
        a, a_end, b, _ = anchors[i]
        r, top, came = ranks[b] - 1, 0.0, -1
        while r > 0:
            if best_from[r] >= 0 and best_score[r] - cost * (a + b) > top:
                top, came = best_score[r] - cost * (a + b), best_from[r]
            r &= r - 1
        score[i], back[i] = (a_end - a) + top, came
        held, r = score[i] + cost * (a + b), ranks[b]
        while r < len(best_score):
            if best_from[r] < 0 or held > best_score[r]:
                best_score[r], best_from[r] = held, i
            r += r & -r
    used, chains = [False] * len(anchors), []
    for i in sorted(order, key=lambda i: -score[i]):
        chain, at = [], i
        while at >= 0 and not used[at]:
            used[at] = True
            chain.append(at)
            at = back[at]
        chain.reverse()
        part = chain[:1]
        for before, now in pairwise(chain):
            near = anchors[now][0] - anchors[before][1] <= max_gap
            if not near or anchors[now][2] - anchors[before][3] > max_gap:
                chains.append(part)
                part = []
            part.append(now)
        if part:
            chains.append(part)
    return chains


_POINTS = "array<int>"


def _thinned(points: list[tuple[int, int, int, int]]) -> tuple[list[tuple[int, int, int, int]], list[list]]:
    """Anchors, and apart from them those that overlap another one of the same source place.

    Only a text that repeats itself word by word has such; of each place the
    first anchor is chained, and all of them are aligned on their own.
    """
    places: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
    for p in points:
        places.setdefault((p[2], p[3]), []).append(p)
    kept, repeats = [], []
    for same in places.values():
        if any(x[1] > y[0] for x, y in pairwise(same)):
            repeats.append(same)
            reached = -1
            for p in same:
                if reached <= p[0]:
                    reached = p[1]
                    kept.append(p)
        else:
            kept += same
    return kept, repeats


_CHAIN = ["doc_id", "source", "at", "source_at", "source_from", "source_to"]


def _marks(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Starts of the long seeds of each document, as rows of chains without a source."""
    long = batch.filter(batch.column(6))
    ids, many = long.column(0), long.num_rows
    docs = ids.to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.r_[many > 0, docs[1:] != docs[:-1]][:many])
    at = pa.ListArray.from_arrays(pa.array(np.r_[cuts, many], pa.int32()), long.column(2))
    points = pa.nulls(len(cuts), pa.list_(pa.int32()))
    place = pa.nulls(len(cuts), pa.int32())
    columns = [ids.take(pa.array(cuts)), pa.nulls(len(cuts), ids.type), at, points, place, place]
    return pa.RecordBatch.from_arrays(columns, names=_CHAIN)


def _chain_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains from anchors sorted by (doc_id, source); one pair is held at a time.

    Anchors that tell which of them are long also give ``_marks``; those of a document with itself do only that.
    """
    held: list[list[np.ndarray]] = []
    key = None
    out: list[tuple] = []
    # The shortest long seed: words of one byte.
    lone = 2 * SEEDS[-1][0] - 1

    def close() -> None:
        if key is None:
            return
        points = np.concatenate(held) if len(held) > 1 else held[0]
        if len(points) == 1 and points[0][1] - points[0][0] < lone:
            return
        rows, repeats = _thinned(sorted(set(map(tuple, points.tolist()))))
        found = [[rows[i] for i in chain] for chain in chains_of(rows)]
        for picked in found + repeats:
            if picked[0][1] - picked[0][0] >= lone or len(picked) > 1 and picked[0][2] != picked[-1][2]:
                out.append((*key, *[[p[c] for p in picked] for c in (0, 2)], picked[0][2], picked[-1][3]))

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        kinds = [ids_type, ids_type, pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int32()]
        made = pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
            names=_CHAIN,
        )
        out.clear()
        return made

    ids_type = pa.int64()
    for batch in batches:
        if batch.num_columns > 6 and batch.num_rows:
            yield _marks(batch)
            batch = batch.filter(pc.not_equal(batch.column(0), batch.column(1)))
        if not batch.num_rows:
            continue
        ids_type = batch.column(0).type
        docs, sources = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        points = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3, 4, 5)])
        cuts = np.flatnonzero((docs[1:] != docs[:-1]) | (sources[1:] != sources[:-1])) + 1
        froms, tos = np.r_[0, cuts], np.r_[cuts, len(docs)]
        # A pair of one short seed makes no chain; at the ends of a batch it may have more of them.
        used = (tos - froms > 1) | (points[froms, 1] - points[froms, 0] >= lone)
        used[0] = used[-1] = True
        for a, b in zip(froms[used].tolist(), tos[used].tolist(), strict=True):
            now = (docs[a], sources[a])
            if now != key:
                close()
                key, held = now, []
            held.append(points[a:b])
        if len(out) > 5000:
            yield flush()
    close()
    yield flush()


def _common_words(a: list[bytes], b: list[bytes]) -> int:
    """Most equal words in an alignment that keeps the order of both (bit-parallel)."""
    first = 0
    while first < len(a) and first < len(b) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    left, right = a[first : len(a) - last], b[first : len(b) - last]
    if not left or not right:
        return first + last
    places: dict[bytes, int] = {}
    for i, x in enumerate(left):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(left)) - 1
    row = full
    for x in right:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & full
    return first + last + len(left) - row.bit_count()


# Words to skip in both texts for one edit or a few, the fewest first.
_STEPS = sorted(
    ((x, y) for x in range(5) for y in range(5) if x or y), key=lambda s: (max(s), abs(s[0] - s[1]))
)
# Unequal words for which nothing is made up, after which an end grows no further.
_LOST = 5


# Words of the longest slice that is compared at once.
_MOST_WORDS = 128


def _equal_words(a: list[bytes], i: int, b: list[bytes], j: int) -> int:
    """Equal words of a[i:] and b[j:] before the first that differ; ever longer slices are compared."""
    length, step = 0, 8
    while True:
        x, y = a[i + length : i + length + step], b[j + length : j + length + step]
        if x != y:
            break
        length += len(x)
        if len(x) < step:
            return length
        step = min(2 * step, _MOST_WORDS)
    for p, q in zip(x, y, strict=False):
        if p != q:
            break
        length += 1
    return length


def _grown(a: list[bytes], b: list[bytes], loss: float) -> list[tuple[int, int, int, int]]:
    """Runs of equal words (i, j, length, unequal words before) that follow one that ended before a[0] and b[0]."""
    found, i, j, behind = [], 0, 0, 0.0
    while behind <= loss * _LOST:
        # The few words in reach are cut out once; most ends have none in common.
        near, far = a[i : i + 6], b[j : j + 6]
        if set(near).isdisjoint(far):
            return found
        for x, y in _STEPS:
            if near[x : x + 1] == far[y : y + 1] and near[x : x + 2] == far[y : y + 2]:
                break
        else:
            return found
        i, j = i + x, j + y
        length = _equal_words(a, i, b, j)
        if not length:
            return found
        found.append((i, j, length, max(x, y)))
        behind = max(0.0, behind + loss * max(x, y) - length)
        i, j = i + length, j + length
    return found


def _widened(
    runs: list[list[int]], first: int, last: int, score: float, min_words: int, loss: float
) -> tuple[int, int]:
    """Word range of the runs ``first`` to ``last``, with runs beside them while it is too short and enough stays equal."""
    while runs[last][0] + runs[last][2] - runs[first][0] < min_words:
        beside = []
        if first:
            beside.append((runs[first - 1][2] + runs[first][3] - loss * runs[first][4], first - 1, last))
        if last + 1 < len(runs):
            beside.append((runs[last + 1][2] + runs[last + 1][3] - loss * runs[last + 1][4], first, last + 1))
        gain, low, high = max(beside, default=(-score - 1, first, last))
        if score + gain < -1e-9:
            break
        score, first, last = score + gain, low, high
    return runs[first][0], runs[last][0] + runs[last][2]


def _passages(
    words: list[bytes], source: list[bytes], anchors: list[tuple[int, int]], min_words: int, similarity: float
) -> list[tuple[int, int]]:
    """Word ranges of passages along one chain of equal words (i, j)."""
    # Runs of equal words and, before each, the columns of the gap: (i, j, length, equal, unequal).
    runs: list[list[int]] = []
    for i, j in anchors:
        if words[i] != source[j] or runs and (i < runs[-1][0] + runs[-1][2] or j < runs[-1][1] + runs[-1][2]):
            continue
        if not runs:
            before = min(i, j)
            back = _equal_words(words[i - before : i][::-1], 0, source[j - before : j][::-1], 0)
            i, j = i - back, j - back
        length = _equal_words(words, i, source, j)
        equal = unequal = 0
        if runs:
            a, b = words[runs[-1][0] + runs[-1][2] : i], source[runs[-1][1] + runs[-1][2] : j]
            equal = _common_words(a, b)
            unequal = max(len(a), len(b)) - equal
        runs.append([i, j, length, equal, unequal])
    found = []
    loss = similarity / (1 - similarity)
    if runs:
        # Both ends go on past edits: the first run is that of the chain only after what grew before it.
        i, j = runs[-1][0] + runs[-1][2], runs[-1][1] + runs[-1][2]
        after = [[i + x, j + y, n, 0, gap] for x, y, n, gap in _grown(words[i : i + 2 * len(source)], source[j:], loss)]
        i, j = runs[0][:2]
        for x, y, n, gap in _grown(words[max(0, i - 2 * j) : i][::-1], source[:j][::-1], loss):
            runs[0][4] = gap
            runs.insert(0, [i - x - n, j - y - n, n, 0, 0])
        runs += after
    first = last = 0
    score = best = 0.0
    for n, (_, _, length, equal, unequal) in enumerate(runs):
        after = score + equal - loss * unequal
        if n and (after <= 0 or best - after > loss * min_words):
            found.append(_widened(runs, first, last, best, min_words, loss))
            after, first, best = 0.0, n, 0.0
        score = after + length
        if score > best:
            best, last = score, n
    if runs:
        found.append(_widened(runs, first, last, best, min_words, loss))
    return [(a, b) for a, b in found if b - a >= min_words]


def _word_starts(text: bytes) -> np.ndarray:
    space = _IS_SPACE[np.frombuffer(b" " + text, np.uint8)]
    return np.flatnonzero(space[:-1] & ~space[1:])


def repeated_ranges(
    text: bytes, passages: list[dict], min_words: int = MIN_WORDS, similarity: float = SIMILARITY
) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Byte offsets of the words of a text, and its passages as (first word, end word, source)."""
    begins, words = _word_starts(text), text.lower().split()
    found = set()
    for p in passages:
        piece, base = p["piece"], p["piece_from"]
        source, places = piece.lower().split(), _word_starts(piece) + base
        # A word at a cut end may be part of a longer one.
        first, last = int(base > 0), len(source) - (not p["piece_is_last"])
        source, places = source[first:last], places[first:last]
        if not source:
            continue
        at, source_at = np.array(p["at"]), np.array(p["source_at"])
        i, j = np.searchsorted(begins, at), np.searchsorted(places, source_at)
        i, j = np.minimum(i, len(words) - 1), np.minimum(j, len(source) - 1)
        good = (begins[i] == at) & (places[j] == source_at)
        anchors = list(zip(i[good].tolist(), j[good].tolist(), strict=True))
        # Anchors of one source place are no chain: each is aligned on its own.
        alone = len(anchors) > 1 and anchors[0][1] == anchors[-1][1]
        for chain in [[x] for x in anchors] if alone else [anchors]:
            for a, b in _passages(words, source, chain, min_words, similarity):
                found.add((a, b, p["source"]))
    return begins, sorted(found)


def _count_words(texts: pa.Array) -> np.ndarray:
    """Words of each text, over the bytes of all of them at once; a null text has none."""
    texts = pc.fill_null(texts, b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    inside = ~_IS_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    # The first byte of a text begins a word whatever stands before it.
    first = offsets[:-1][np.diff(offsets) > 0]
    begins[first] = inside[first]
    seen = np.flatnonzero(begins)
    return np.searchsorted(seen, offsets[1:]) - np.searchsorted(seen, offsets[:-1])


def _untouched(batch: pa.RecordBatch, span: pa.DataType) -> pa.RecordBatch:
    """Results of texts without anchors or windows, which go on as they are."""
    many = batch.num_rows
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0),
            batch.column(4),
            pa.array(_count_words(batch.column(1)), pa.int64()),
            pa.array(np.zeros(many, np.int64)),
            pa.ListArray.from_arrays(pa.array(np.zeros(many + 1, np.int32)), pa.array([], span)),
            batch.column(1),
        ],
        names=["doc_id", "digest", "n_words", "n_removed", "spans", "kept"],
    )


def _cut_batches(id_type: str):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Handed on in small parts, so that no batch is held twice.
            plain = np.array(batch.column(2).is_null()) & np.array(batch.column(3).is_null())
            untouched, others = batch.filter(pa.array(plain)), batch.filter(pa.array(~plain))
            if untouched.num_rows:
                yield _untouched(untouched, span_of(untouched))
            for at in range(0, others.num_rows, _ROWS):
                yield cut_part(others.slice(at, _ROWS))

    def span_of(batch: pa.RecordBatch) -> pa.DataType:
        source = ("source", batch.column(0).type)
        return pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), source])

    def cut_part(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns: dict[str, list] = {k: [] for k in ("doc_id", "digest", "n_words", "n_removed", "spans", "kept")}
        for i in range(batch.num_rows):
            text = batch.column(1)[i].as_py()
            pieces, windows = batch.column(2)[i].as_py(), batch.column(3)[i].values
            columns["doc_id"].append(batch.column(0)[i].as_py())
            columns["digest"].append(batch.column(4)[i].as_py())
            starts, found = repeated_ranges(text or b"", pieces or [])
            gone = np.zeros(len(starts) + 1, bool)
            for a, b, _ in found:
                gone[a:b] = True
            exact = [] if windows is None else exact_ranges(text or b"", windows, gone)
            for a, b, _ in exact:
                gone[a:b] = True
            found = sorted(found + exact)
            kept = text
            if found:
                begins = [*starts.tolist(), len(text)]
                edges = np.flatnonzero(np.diff(np.r_[False, gone].astype(np.int8)))
                bounds = [0, *[begins[e] for e in edges], len(text)]
                kept = b"".join(text[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True))
            columns["n_words"].append(len(starts))
            columns["n_removed"].append(int(gone.sum()))
            columns["spans"].append(
                [{"first_word": a, "end_word": b, "source": s} for a, b, s in found]
            )
            columns["kept"].append(kept)
        span = span_of(batch)
        kinds = [batch.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.list_(span), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(v, k) for v, k in zip(columns.values(), kinds, strict=True)], names=list(columns)
        )

    schema = (
        f"doc_id {id_type}, digest long, n_words long, n_removed long, "
        f"spans array<struct<first_word:bigint,end_word:bigint,source:{id_type}>>, kept binary"
    )
    return cut, schema


def remove_passages(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, spans, kept.

    A passage is a stretch of at least 50 words of which 80 % align with words
    of a document with a smaller doc_id; case of A-Z and white space do not
    count. ``spans`` are its word ranges with the earlier document, ``kept`` is
    the text without them. Exact passages are all found; the seeds of others are
    matched with their first occurrence. A null text stays null (no words); rows without a doc_id are kept untouched
    and are nobody's source. Rows that repeat a doc_id with the same text get
    the same answer. Other columns are ignored.
    """
    return _removed(docs).drop("digest").withColumn("kept", F.col("kept").cast("string"))


def _removed(docs: DataFrame) -> DataFrame:
    """``remove_passages`` with ``kept`` as bytes and the digest of each text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sorted_anchors = _anchors(docs).repartition("doc_id", "source").sortWithinPartitions(
        "doc_id", "source", "start", "source_start"
    )
    found = store(
        sorted_anchors.mapInArrow(
            _chain_batches,
            f"doc_id {kind}, source {kind}, at {_POINTS}, source_at {_POINTS}, source_from int, source_to int",
        )
    )
    chains = found.where("source is not null")
    marks = found.where("source is null").groupBy("doc_id").agg(F.flatten(F.collect_list("at")).alias("_starts"))
    sources = docs.select(F.col("doc_id").alias("source"), utf8("text").alias("_text")).where("source is not null")
    begin = F.greatest(F.lit(0), F.col("source_from") - CONTEXT)
    size = F.col("source_to") + CONTEXT - begin
    pieces = store(
        chains.join(sources, "source").select(
            "doc_id",
            "source",
            "at",
            "source_at",
            begin.alias("piece_from"),
            F.substring("_text", begin + 1, size).alias("piece"),
            (begin + size >= F.octet_length("_text")).alias("piece_is_last"),
        )
    )
    per_doc = pieces.groupBy(F.col("doc_id").alias("_doc")).agg(
        F.collect_list(F.struct("source", "at", "source_at", "piece_from", "piece", "piece_is_last")).alias("_pieces")
    )
    cut, schema = _cut_batches(kind)
    texts = docs.select("doc_id", utf8("text").alias("_text"), F.xxhash64(utf8("text")).alias("_digest"))
    exact = _exact_windows(docs, marks)
    joined = texts.join(per_doc, texts["doc_id"] == per_doc["_doc"], "left")
    joined = joined.join(exact, texts["doc_id"] == exact["_exact_doc"], "left")
    return joined.select("doc_id", "_text", "_pieces", "_windows", "_digest").mapInArrow(cut, schema)


def without_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``; a document of which no word is left goes.

    ``n_chars``, where it is a column, is counted anew for changed texts. Rows
    that lose nothing stay exactly as they are. A repeated doc_id with another text is cut by
    what was found in that text.
    """
    found = _removed(docs).where("n_removed > 0 and doc_id is not null")
    found = found.select("doc_id", "digest", "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))
    changed = store(found.dropDuplicates(["doc_id", "digest"]))
    plan = changed.select(
        F.col("doc_id").alias("_doc"),
        F.col("digest").alias("_digest"),
        F.col("kept").alias("_kept"),
        (F.col("n_words") == F.col("n_removed")).alias("_gone"),
    )
    rows = docs.select("doc_id", F.xxhash64(utf8("text")).alias("_own"), F.struct(*docs.columns).alias("_row"))
    same = (F.col("doc_id") == F.col("_doc")) & (F.col("_own") == F.col("_digest"))
    joined = rows.join(plan, same, "left").where("_gone is null or not _gone")
    text = F.coalesce("_kept", F.col("_row.text"))
    columns = []
    for name in docs.columns:
        value = F.col("_row").getField(name)
        if name == "text":
            value = text
        elif name == "n_chars":
            kind = docs.schema[name].dataType
            value = F.when(F.col("_doc").isNull(), value).otherwise(F.char_length("_kept").cast(kind))
        columns.append(value.alias(name))
    return joined.select(*columns)
