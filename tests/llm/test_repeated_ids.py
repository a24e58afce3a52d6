"""Nothing is lost that no other document has: missing labels, repeated ids with other texts."""

import random

import pyarrow as pa

from traceflow.llm import langid, passages, simhash, suffixes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, digest int"


def words(seed, many):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(many))


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x", 1) for i, t, lang in rows], SCHEMA)


def left(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in df.collect())


def test_language_stage_without_labels(spark):
    docs = table(spark, [(1, "clean words", None), (2, "more of them", None), (3, "12 34", None), (4, None, None), (None, "x", None)])
    kept = langid.keep_identified(docs)
    assert left(kept) == [(-1, "x"), (1, "clean words"), (2, "more of them")]
    assert kept.columns == docs.columns and kept.schema["digest"].dataType == docs.schema["digest"].dataType
    assert langid.keep_identified(docs.limit(0)).count() == 0


def test_language_stage_judges_rows(spark):
    docs = table(spark, [(1, "the clean words", "en"), (1, "1234", "en"), (2, "les mots propres", "fr"), (None, "!", "fr")] * 3)
    assert left(langid.keep_identified(docs)) == sorted([(1, "the clean words"), (2, "les mots propres")] * 3)


def test_repeated_id_with_another_text_keeps_it(spark):
    copied, own = words(1, 60), words(2, 60)
    docs = table(spark, [(1, copied, "en"), (5, copied, "en"), (5, own, "en"), (6, own, "en"), (7, words(3, 60), "en")])
    assert left(simhash.keep_representatives(docs)) == sorted([(1, copied), (5, own), (7, words(3, 60))])
    cut = {(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffixes.remove_repeated(docs).collect()}
    size, other = len(copied), len(own)
    assert cut == {(1, size, 0), (5, size, size), (5, other, 0), (6, other, other), (7, len(words(3, 60)), 0)}
    assert left(passages.without_passages(docs)) == sorted([(1, copied), (5, own), (7, words(3, 60))])


def test_words_are_counted_in_bulk():
    texts = [b"", None, b" ", b"a", b"a b", b"ab", b" a\tb\n", b"\x0b\x0c", b"x" * 50, b"", "é ü".encode()]
    batch = pa.array([b"cut", *texts, b"off"], pa.binary()).slice(1, len(texts))
    assert passages._count_words(batch).tolist() == [len((t or b"").split()) for t in texts]


def test_rows_that_repeat_a_kept_document_count_once(spark):
    text = words(4, 40)
    docs = table(spark, [(3, text, "en"), (3, text, "en"), (3, words(5, 40), "en"), (None, text, "en"), (None, text, "en")])
    assert left(simhash.keep_representatives(docs)) == sorted([(-1, text), (-1, text), (3, text), (3, words(5, 40))])


def test_language_stage_sends_texts_alone(spark):
    """Rows stay with Spark: a task of the stage holds neither whole rows nor its texts twice in Arrow batches."""
    docs = table(spark, [(i, words(i, 3), "en") for i in range(9)] + [(9, "12 34", "en")])
    kept = langid.keep_identified(docs)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan
    sent = [line for line in plan.splitlines() if "ArrowEvalPython" in line]
    assert all("n_chars" not in line.partition("(")[2].partition("]")[0] for line in sent)
    assert [i for i, _ in left(kept)] == list(range(9))


def test_language_stage_beyond_one_slice(spark, monkeypatch):
    monkeypatch.setattr(langid, "KEPT_ROWS", 4)
    rows = [(i, None if i % 7 == 0 else "12 34" if i % 5 == 0 else words(i, 4), "en") for i in range(50)]
    kept = langid.keep_identified(table(spark, rows).coalesce(1))
    assert left(kept) == [(i, t) for i, t, _ in rows if t and t != "12 34"]
