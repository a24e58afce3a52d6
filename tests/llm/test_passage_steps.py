"""Alignment and chaining take few Python steps for long equal runs and for pairs without a chain."""

import random
import re
import sys

import numpy as np
import pyarrow as pa

from traceflow.llm import passages


def steps_of(f, *args):
    """Lines of ``passages`` that a call runs, with its result."""
    seen = 0

    def trace(frame, event, _):
        nonlocal seen
        if frame.f_code.co_filename != passages.__file__:
            return None
        seen += event == "line"
        return trace

    before = sys.gettrace()
    sys.settrace(trace)
    try:
        return f(*args), seen
    finally:
        sys.settrace(before)


def test_long_equal_runs_are_not_walked_word_by_word():
    words = [b"w%d" % i for i in range(20_000)]
    found, steps = steps_of(passages._passages, [b"x", *words, b"y"], [b"u", *words, b"v"], [(9_000, 9_000)], 50, 0.8)
    assert found == [(1, 20_001)]
    assert steps < 2_000


def test_windows_in_a_row_are_not_walked_one_by_one():
    text = b" ".join(b"w%d" % i for i in range(5_000))
    hashed, at = passages.windows_of(text, passages._word_starts(text))
    sources = [7] * 1_000 + [3] * (len(at) - 1_000)
    twice = [np.r_[x, x] for x in (at, hashed, sources)]
    windows = pa.StructArray.from_arrays([pa.array(x) for x in twice], ["at", "window", "source"])
    found, steps = steps_of(passages.exact_ranges, text, windows, np.zeros(5_001, bool))
    assert found == [(0, 1_049, 7), (1_000, 5_000, 3)]
    assert steps < 500
    assert passages.exact_ranges(b"other words", windows, np.zeros(3, bool)) == []


def test_pairs_of_one_short_seed_are_not_walked():
    columns = [np.arange(3_000), np.zeros(3_000, np.int64), *[np.full(3_000, x, np.int32) for x in (5, 30, 9, 34)]]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=list("abcdef"))
    found, steps = steps_of(lambda b: [r for x in passages._chain_batches(iter(b)) for r in x.to_pylist()], [batch])
    assert found == [] and steps < 500


def test_pairs_over_the_ends_of_batches():
    rows = [(1, 0, 5, 30, 9, 34), (2, 0, 5, 30, 9, 34), (2, 0, 40, 65, 44, 69), (3, 0, 5, 30, 9, 34), (4, 0, 5, 80, 9, 84)]
    found = []
    for many in (1, 2, 5):
        batches = [
            pa.RecordBatch.from_pylist([dict(zip("abcdef", r, strict=True)) for r in rows[at : at + many]])
            for at in range(0, len(rows), many)
        ]
        found.append([r["doc_id"] for x in passages._chain_batches(iter(batches)) for r in x.to_pylist()])
    assert found == [[2, 4]] * 3


def test_long_seeds_are_told_beside_the_chains():
    """Anchors of a document with itself give marks alone; at any cut into batches."""
    rows = [(1, 1, 5, 80, 5, 80, True), (2, 1, 5, 80, 5, 80, True), (2, 1, 90, 99, 90, 99, False), (2, 2, 3, 60, 3, 60, True), (3, 1, 7, 9, 5, 8, False)]
    for ids in (pa.int64(), pa.string()):
        for many in (1, 2, 5):
            parts = [rows[at : at + many] for at in range(0, len(rows), many)]
            kinds = [ids, ids, *[pa.int32()] * 4, pa.bool_()]
            batches = [
                pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names=list("abcdefg"))
                for part in parts
            ]
            found = [r for x in passages._chain_batches(iter(batches)) for r in x.to_pylist()]
            marks = {}
            for r in found:
                if r["source"] is None:
                    marks.setdefault(int(r["doc_id"]), []).extend(r["at"])
            assert marks == {1: [5], 2: [5, 3]}
            assert [(int(r["doc_id"]), int(r["source"]), r["at"]) for r in found if r["source"] is not None] == [(2, 1, [5, 90])]


def test_texts_are_read_twice_for_seeds(spark, monkeypatch):
    """Once for first occurrences and once for anchors, from which long seeds are known as well."""
    used, stored = [], passages.store

    def storing(frame):
        used.append(frame._jdf.queryExecution().optimizedPlan().toString())
        return stored(frame)

    monkeypatch.setattr(passages, "store", storing)
    words = " ".join(f"w{i}" for i in range(70))
    docs = spark.createDataFrame([(1, "x " + words), (2, words + " y"), (3, "z")], "doc_id long, text string")
    rows = {r["doc_id"]: r["n_removed"] for r in passages.remove_passages(docs).collect()}
    assert rows == {1: 0, 2: 70, 3: 0}
    assert sum(len(re.findall(r"MapInArrow .*\[seed#", plan)) for plan in used) == 2


def test_equal_words_at_all_places():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice([b"a", b"a", b"a", b"b"]) for _ in range(rng.randrange(60))] for _ in range(2))
        i, j = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)
        b[j:] = a[i:][: rng.randrange(40)] + b[j + 5 :]
        length = 0
        while i + length < len(a) and j + length < len(b) and a[i + length] == b[j + length]:
            length += 1
        assert passages._equal_words(a, i, b, j) == length


def test_word_starts():
    for text in (b"", b" ", b"a", b" a", b"a ", b"ab  c\n\td "):
        found = [i for i in range(len(text)) if not text[i : i + 1].isspace() and (i == 0 or text[i - 1 : i].isspace())]
        assert passages._word_starts(text).tolist() == found
