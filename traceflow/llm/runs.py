"""Periodic runs of words by recursive frequency splitting.

A run of period q holds each of its words at least twice, as it is at least two
periods long. So a word that occurs once in a stretch of text is in no run and
splits the stretch; the parts are counted again, until nothing splits. Only the
stretches that survive are scanned, lag by lag. Lags below ``SHORT`` are compared
directly. For lags from Q to 2Q a run has equal blocks of Q/2 words at a multiple
of Q/2 and one lag further, so exact names of all blocks of Q/2 words give the lags
to try there; how far a lag holds is looked up in the names of blocks of 1, 2,
4, ... words. Nothing is hashed, so nothing can be missed or found by chance.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceflow.llm.common import utf8

MIN_LENGTH = 12
# Occurrences a word has in a run at least.
MIN_COUNT = 2
# Lags below are compared word by word. A power of two.
SHORT = 64
# Words handled at once; a longer text is handled alone.
CHUNK_WORDS = 200_000

RUNS = "array<struct<start:long,length:long,period:long>>"


def surviving(words: np.ndarray, bounds: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches that recursive frequency splitting leaves.

    ``words`` are ids of the words of several texts, ``bounds`` the first places of the texts and the end.
    """
    starts, lengths = bounds[:-1], np.diff(bounds)
    kinds = int(words.max(initial=0)) + 1
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        long = lengths >= min_length
        starts, lengths = starts[long], lengths[long]
        if not len(starts):
            break
        part = np.repeat(np.arange(len(starts)), lengths)
        first = np.cumsum(lengths) - lengths
        at = np.arange(len(part)) - np.repeat(first - starts, lengths)
        _, which, count = np.unique(part * kinds + words[at], return_inverse=True, return_counts=True)
        rare = count[which] < MIN_COUNT
        split = np.zeros(len(starts), bool)
        split[part[rare]] = True
        found.append((starts[~split], lengths[~split]))
        # What is left between rare words, and between stretches, is a new stretch.
        keep = ~rare & split[part]
        at, part = at[keep], part[keep]
        new = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(part) != 0)][: len(at)])
        starts, lengths = at[new], np.diff(np.r_[new, len(at)])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([s for s, _ in found]), np.concatenate([n for _, n in found])


def _stretches(text: np.ndarray, lag: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of at least ``least`` neighbours that equal the word one lag further."""
    same = np.flatnonzero(text[lag:] == text[:-lag])
    if len(same) < least:
        return same[:0], same[:0]
    cut = np.flatnonzero(np.diff(same) != 1)
    first, last = same[np.r_[0, cut + 1]], same[np.r_[cut, len(same) - 1]] + 1
    long = last - first >= least
    return first[long], last[long]


def _block_names(text: np.ndarray, longest: int) -> list[np.ndarray]:
    """names[k][i] is equal for two places iff their blocks of 2**k words are equal."""
    names = [text.astype(np.int64)]
    while 2 << (len(names) - 1) <= longest:
        half = 1 << (len(names) - 1)
        last = names[-1]
        pairs = last[:-half] * (len(text) + 1) + last[half:]
        names.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))
    return names


def _reach(names: list[np.ndarray], left: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far equality at a lag goes back from ``left`` and on from it."""
    start, end = left.copy(), left.copy()
    # A block may be needed more than once at the largest size only.
    for level in [len(names) - 1] * 3 + list(range(len(names) - 2, -1, -1)):
        name, size = names[level], 1 << level
        top = len(name) - 1
        on = end + lag <= top
        on &= name[np.minimum(end, top)] == name[np.minimum(end + lag, top)]
        end[on] += size
        back = start >= size
        back &= name[np.clip(start - size, 0, top)] == name[np.clip(start - size + lag, 0, top)]
        back &= start - size + lag <= top
        start[back] -= size
    return start, end


def _long_lags(text: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, end, lag) of stretches of equality at lags of ``SHORT`` words and more."""
    if not len(lengths) or lengths[0] < 2 * SHORT:
        return
    ends = np.cumsum(lengths + 1)
    names = _block_names(text[: ends[np.searchsorted(-lengths, -2 * SHORT, "right") - 1]], lengths[0] // 2)
    low = SHORT
    while 2 * low <= lengths[0]:
        size = ends[np.searchsorted(-lengths, -2 * low, "right") - 1]
        block = low // 2
        name = names[block.bit_length() - 1][:size]
        keys = np.sort(name * (size + 1) + np.arange(len(name)))
        anchors = np.arange(0, len(name), block)
        base = name[anchors] * (size + 1)
        first = np.searchsorted(keys, base + np.minimum(anchors + low, size))
        many = np.searchsorted(keys, base + np.minimum(anchors + 2 * low, size)) - first
        place = np.repeat(anchors, many)
        nth = np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many)
        lag = keys[np.repeat(first, many) + nth] - np.repeat(base, many) - place
        # In a run there are several anchors; one is enough to find its ends.
        for at in range(0, len(place), CHUNK_WORDS):
            p, q = place[at : at + CHUNK_WORDS], lag[at : at + CHUNK_WORDS]
            start, end = _reach(names, p, q)
            long = end - start >= q
            yield start[long], end[long], q[long]
        low *= 2


def runs_of(words: np.ndarray, bounds: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period; starts count over all texts.

    Two lags that hold over the same longest stretch have a common divisor that does,
    so the least of them is the period.
    """
    starts, lengths = surviving(words, bounds, min_length)
    if not len(starts):
        return np.zeros((0, 3), np.int64)
    # Longest first, so that a lag reads only what is long enough; a word that occurs once follows each.
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    ends = np.cumsum(lengths + 1)
    shift = starts - (ends - lengths - 1)
    stretch = np.repeat(np.arange(len(starts)), lengths + 1)
    at = np.arange(ends[-1]) + shift[stretch]
    mark = np.zeros(ends[-1], bool)
    mark[ends - 1] = True
    text = np.where(mark, 0, words[np.minimum(at, len(words) - 1)])
    kinds = np.unique(text, return_inverse=True)[1]
    kinds[mark] = kinds.max() + 1 + np.arange(len(starts))
    text = np.unique(kinds, return_inverse=True)[1].astype(np.int32)
    found = []
    for lag in range(1, min(SHORT, lengths[0] // 2 + 1)):
        size = ends[np.searchsorted(-lengths, -max(min_length, 2 * lag), "right") - 1]
        first, last = _stretches(text[:size], lag, max(min_length - lag, lag))
        found.append(np.stack([first, last + lag, np.full(len(first), lag)], 1))
    found += [np.stack([s, e + q, q], 1) for s, e, q in _long_lags(text, lengths)]
    rows = np.concatenate(found)
    rows = rows[rows[:, 1] - rows[:, 0] >= min_length]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    fresh = np.r_[True, (np.diff(rows[:, :2], axis=0) != 0).any(axis=1)][: len(rows)]
    rows = rows[fresh]
    rows = np.stack([rows[:, 0] + shift[stretch[rows[:, 0]]], rows[:, 1] - rows[:, 0], rows[:, 2]], 1)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _chunk(ids: list[pa.Array], texts: list[list[bytes]], min_length: int) -> pa.RecordBatch:
    """One row per text: its words, runs and what is left without repeated periods."""
    bounds = np.cumsum([0, *map(len, texts)])
    flat = [w for words in texts for w in words]
    kinds = pa.array(flat, pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    rows = runs_of(kinds, bounds, min_length)
    depth = np.zeros(len(flat) + 1, np.int64)
    np.add.at(depth, rows[:, 0] + rows[:, 2], 1)
    np.add.at(depth, rows[:, 0] + rows[:, 1], -1)
    kept = np.cumsum(depth[:-1]) == 0
    owner = np.searchsorted(bounds, rows[:, 0], "right") - 1
    left = []
    for k, words in enumerate(texts):
        here = kept[bounds[k] : bounds[k + 1]]
        left.append(b" ".join(words if here.all() else [words[i] for i in np.flatnonzero(here)]))
    fields = [rows[:, 0] - bounds[owner], rows[:, 1], rows[:, 2]]
    listed = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(f, pa.int64()) for f in fields], ["start", "length", "period"]),
    )
    counts = pa.array(np.diff(bounds), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.concat_arrays(ids), counts, listed, pa.array(left, pa.binary())],
        names=["doc_id", "n_words", "runs", "collapsed"],
    )


def _batches(min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for k in range(batch.num_rows):
                words = (batch.column(1)[k].as_py() or b"").split()
                if texts and size + len(words) > CHUNK_WORDS:
                    yield _chunk(ids, texts, min_length)
                    ids, texts, size = [], [], 0
                ids.append(batch.column(0).slice(k, 1))
                texts.append(words)
                size += len(words)
            if texts:
                yield _chunk(ids, texts, min_length)

    return run


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs, collapsed.

    Words are what stands between ASCII white space. ``runs`` lists every stretch
    (start, length, period) of at least ``min_length`` words and two periods
    that no neighbouring word extends, by start and period; ``period`` is the least one and
    starts count words from zero. ``collapsed`` is the text without the words that any run has
    after its first period, joined by single spaces.

    Null and wordless texts have no runs and an empty ``collapsed``. Runs may
    overlap; equal starts are ordered by period. Rows are independent: repeated rows, repeated and
    null ids are all returned. An empty table gives no rows, other columns are
    ignored. A text is read whole by one task, in about 200 bytes of memory a word.
    """
    if min_length < 2:
        raise ValueError("a run has at least two words")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", utf8("text").alias("text")).mapInArrow(
        _batches(min_length), f"doc_id {kind}, n_words long, runs {RUNS}, collapsed binary"
    )
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def repeat_tail(docs: DataFrame) -> DataFrame:
    """``docs`` with a periodic tail in the texts of about a tenth of the ids.

    With h the CRC-32 of the decimal doc_id and g = h div 10, texts of n > 0 words
    whose h ends in 0 repeat, from word a = g mod n on, the p = 1 + (n - a) div (3 + g mod 8)
    words that stand there. Other texts, and those of a null id, stay.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    chosen = docs.withColumn("_g", F.when(h % 10 == 0, g))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    split = chosen.withColumn("_words", F.when(F.col("_g").isNotNull(), words))
    n = F.size("_words")
    a = (F.col("_g") % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + F.col("_g") % 8))).cast("int")
    period = F.slice("_words", a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int"))), 1, n - a)
    made = F.array_join(F.concat(F.slice("_words", F.lit(1), a), tail), " ")
    return split.withColumn("text", F.when(n > 0, made).otherwise(F.col("text"))).select(*docs.columns)
