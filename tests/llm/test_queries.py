"""Registered queries against SQL, or against a plain computation in this file."""

import hashlib
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.brute import passages_union, repeated_bytes, simhash_components
from tools.compare import compare, connect
from traceflow.llm import langid, queries
from traceflow.llm.licenses import TEMPLATES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, con, name):
    assert compare(queries.queries()[name](spark, SF), con, queries.oracle_sql()[name]) == ""


def test_simhash(spark, documents):
    want = simhash_components([(i, t) for i, t, _ in documents])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op10_simhash(spark, SF).collect()}
    assert got == want


def test_suffix_dedup(spark, documents):
    want = repeated_bytes([(i, t) for i, t, _ in documents])
    got = {}
    for r in queries.op7_suffix_dedup(spark, SF).collect():
        got[r["doc_id"]] = (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
    assert {
        i: (n, k, s, hashlib.sha256(kept).hexdigest()) for i, (n, k, s, kept) in want.items()
    } == got


def test_language_id(spark, documents):
    lang = {i: x for i, _, x in documents}
    rows = queries.op9_language_id(spark, SF).collect()
    assert len(rows) == len(documents)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert langid.SAMPLE_ROWS * langid.SAMPLE_CHARS <= 1 << 16


def test_license_scan(spark, documents):
    got = {r["doc_id"]: set(filter(None, r["licenses"].split(","))) for r in queries.op8_license_scan(spark, SF).collect()}
    for i, text, _ in documents:
        literal = {k for k, t in TEMPLATES.items() if t in (text or "")}
        assert literal <= got[i]
        assert got[i] == literal


def test_passages(spark, documents):
    """Words in exact repeats of 50 words are all found, and no more than near repeats besides."""
    least = passages_union([(i, t) for i, t, _ in documents], 50)
    rows = {r["doc_id"]: r for r in queries.op4_substring_dedup(spark, SF).collect()}
    assert len(rows) == len(documents)
    for i, words in least.items():
        assert rows[i]["n_removed"] >= words
    clean = [i for i, words in passages_union([(i, t) for i, t, _ in documents], 8).items() if not words]
    assert clean and all(rows[i]["n_removed"] == 0 for i in clean)


def test_pipeline(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    ids = {i for i, _, _ in documents}
    simhash = {i: c for i, (_, c) in simhash_components([(i, t) for i, t, _ in documents]).items()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert docs.count() == len(now) and now <= ids
        if name == "language_id":
            assert ids - now == {i for i, t, _ in documents if not any(c.isalpha() for c in t or "")}
        if name == "near_dedup":
            assert now == {i for i in ids if simhash[i] == i}
        if name != "mix":
            assert docs.columns == columns
        ids = now
    final = corpus_pipeline.run(spark, SF)
    assert {(r["doc_id"], r["taken"]) for r in final.collect()} == {
        (r["doc_id"], r["taken"]) for r in docs.collect()
    }
    assert all(0 < r["taken"] <= 2 * r["size"] for r in docs.collect())
