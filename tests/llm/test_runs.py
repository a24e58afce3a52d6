"""Periodic runs against the definition, word by word."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from traceflow.llm import queries, runs

SF = "/root/testdata/sf0.001"


def plain_runs(words, least=12):
    found = {}
    for lag in range(1, len(words) // 2 + 1):
        i = 0
        while i + lag < len(words):
            first = i
            while i + lag < len(words) and words[i] == words[i + lag]:
                i += 1
            if i - first + lag >= max(least, 2 * lag):
                found.setdefault((first, i - first + lag), lag)
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def planted(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def expected(words):
    found = plain_runs(words)
    gone = set()
    for s, n, q in found:
        gone.update(range(s + q, s + n))
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return (
        len(found),
        *best,
        1000 * best[1] // best[2] if found else None,
        hashlib.sha256(lines.encode()).hexdigest(),
        hashlib.sha256(kept).hexdigest(),
    )


def texts(seed):
    rng = random.Random(seed)
    for _ in range(rng.randint(1, 5)):
        kinds = rng.choice([1, 2, 3, 6, 40])
        words = [rng.randrange(kinds) for _ in range(rng.choice([0, 5, 12, 40, 250]))]
        for _ in range(rng.randint(0, 3)):
            period = [rng.randrange(kinds + 4) for _ in range(rng.choice([1, 2, 5, 17, 80, 140]))]
            words += (period * 6)[: 2 * len(period) + rng.randint(-2, 40)]
            words += [rng.randrange(kinds) for _ in range(rng.randint(0, 9))]
        yield words


@pytest.mark.parametrize("short", [2, 8, 64])
def test_runs_are_those_of_the_definition(monkeypatch, short):
    """Also with most lags found by names of blocks."""
    monkeypatch.setattr(runs, "SHORT", short)
    for seed in range(120):
        docs = list(texts(seed))
        bounds = np.cumsum([0, *map(len, docs)])
        flat = np.array([w for d in docs for w in d], np.int64)
        got = [tuple(map(int, r)) for r in runs.runs_of(flat, bounds)]
        assert got == sorted((s + b, n, q) for d, b in zip(docs, bounds.tolist()) for s, n, q in plain_runs(d))


def test_splitting_keeps_every_run():
    for seed in range(120):
        docs = list(texts(seed))
        bounds = np.cumsum([0, *map(len, docs)])
        flat = np.array([w for d in docs for w in d], np.int64)
        starts, lengths = runs.surviving(flat, bounds)
        kept = {i for s, n in zip(starts, lengths) for i in range(s, s + n)}
        for d, b in zip(docs, bounds.tolist()):
            for s, n, _ in plain_runs(d):
                assert kept.issuperset(range(s + b, s + b + n))


def test_rare_words_split_until_nothing_does():
    # 7 stands once; the 5 on either side of it then do; nothing is left.
    words = np.array([5, 1, 1, 1, 1, 1, 1, 7, 2, 2, 2, 2, 2, 2, 5])
    assert len(runs.surviving(words, np.array([0, 15]))[0]) == 0
    starts, lengths = runs.surviving(np.array([9] + [1, 2] * 6 + [8]), np.array([0, 14]))
    assert (starts.tolist(), lengths.tolist()) == ([1], [12])


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert got == {i: expected(planted(i, t)) for i, t in docs}
    assert sum(r[0] > 0 for r in got.values()) > 5


def test_edges(spark):
    """Null, empty, wordless, repeated and long texts, null ids, clashing columns, several white spaces."""
    long = " ".join(["ab", "cd", "ef"] * 50_000)
    rows = [
        (1, None, 5),
        (2, "", 5),
        (3, " \t\n\x0b\f\r ", 5),
        (4, "a " * 12, 5),
        (4, "a " * 12, 5),
        (None, "x\ty\n" * 6, 5),
        (5, "a " * 11, 5),
        (6, long, 5),
        (7, "ein wort " * 12, 5),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = sorted(
        ((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.find_runs(docs).collect()),
    )
    assert got == [
        (0, 12, [(0, 12, 2)], "x y"),
        (1, 0, [], ""),
        (2, 0, [], ""),
        (3, 0, [], ""),
        (4, 12, [(0, 12, 1)], "a"),
        (4, 12, [(0, 12, 1)], "a"),
        (5, 11, [], " ".join("a" * 11)),
        (6, 150_000, [(0, 150_000, 3)], "ab cd ef"),
        (7, 12, [(0, 12, 1)], "ein wort"),
    ]
    assert runs.find_runs(docs.limit(0)).count() == 0
    assert runs.repeat_tail(docs).where("doc_id is null or doc_id < 4").count() == 4


def test_chunks_do_not_matter(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(map(str, d))) for i, d in enumerate(texts(3))], "doc_id long, text string")
    whole = sorted(map(str, runs.find_runs(docs).collect()))
    batch = [(b"a b " * 8).split(), [], (b"c " * 20).split()]
    monkeypatch.setattr(runs, "CHUNK_WORDS", 1)
    assert sorted(map(str, runs.find_runs(docs).collect())) == whole
    assert batch


def test_overlapping_runs(spark):
    """A long period of a short one: both are runs, each drops what follows its first period."""
    text = "a a a a a a a a a a a a b " * 2
    row = runs.find_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 12, 1), (0, 26, 13), (13, 12, 1)]
    assert row["collapsed"] == "a b"
