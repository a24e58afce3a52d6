"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from traceflow.llm import chat, contamination, langid, licenses, mixing, passages, simhash, suffixes, vectors, warc
from traceflow.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}q" for i in range(3000)]


def text_of(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    long = text_of(1, 30_000)
    base = text_of(2, 200)
    near = base.split()
    near[100] = "changed"
    passage = text_of(3, 80)
    rows = [
        (1, long, "en", "a", 0),
        (2, base, "en", "a", 0),
        (3, base, None, None, 0),
        (4, " ".join(near), "en", "b", 0),
        (5, text_of(4, 300) + " " + passage + " " + text_of(5, 100), "en", None, 0),
        (6, text_of(6, 100) + "\n" + passage.upper() + "\t" + text_of(7, 10), "fr", "b", 0),
        (7, None, "en", "a", 0),
        (8, "", "fr", "c", 0),
        (9, "  \n ", None, "c", 0),
        (10, "x", "fr", "a", 0),
        (10, "x", "fr", "a", 0),
        (11, "12 34 5", "de", "a", 0),
        (None, base, "en", "a", 0),
        (None, None, None, None, None),
        (12, long, "en", "a", 0),
    ]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def clashing(docs):
    """The same with columns named as the operators' own."""
    return docs.select(
        "*",
        *[
            F.lit(9).alias(n)
            for n in "mark id table key members component seed start end first source_start slab ids data bytes "
            "size taken target _bucket _order replies label vec_id held_out n_words spans items".split()
        ],
    )


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.where("doc_id is not null").collect()}


def known(docs):
    return [(r["doc_id"], r["text"]) for r in docs.where("doc_id is not null").collect()]


OPERATORS = {
    "simhash": simhash.near_duplicates,
    "language": langid.identify,
    "passages": passages.remove_passages,
    "mixing": mixing.plan_mix,
    "suffixes": suffixes.remove_repeated,
    "licenses": licenses.find_licenses,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_columns_and_rows(docs, clashing, name):
    """One row per row, and other columns change nothing."""
    rows = lambda df: sorted(map(repr, OPERATORS[name](df).collect()))
    plain = rows(docs)
    assert len(plain) == docs.count()
    assert plain == rows(clashing)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(docs, name):
    assert OPERATORS[name](docs.limit(0)).count() == 0


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_on_empty_and_clashing_tables(spark, docs, clashing, stage, monkeypatch):
    monkeypatch.setattr(
        corpus_pipeline, "table", lambda *_: spark.createDataFrame([(1, "none of these")], "item_id long, text string")
    )
    assert stage(spark, docs.limit(0), "").count() == 0
    plain = stage(spark, docs, "")
    names = [c for c in plain.columns if c in docs.columns]
    rows = lambda df: sorted(map(repr, df.select(names).collect()))
    assert rows(plain) == rows(stage(spark, clashing, ""))


def test_simhash_edges(docs):
    got = by_id(simhash.near_duplicates(docs), "fingerprint", "component_id")
    assert got == brute.simhash_components(known(docs))
    assert got[7] == got[8] == got[9] == ("0" * 16, 7)
    kept = [r["doc_id"] for r in simhash.keep_representatives(docs).collect()]
    assert kept.count(10) == 1 and 3 not in kept and 12 not in kept and kept.count(None) == 2


@pytest.mark.parametrize("bucket", [1, 2, 1000])
def test_simhash_bucket_paths_agree(spark, bucket):
    """Small buckets by pairs and large ones by variants connect the same marks."""
    rng = random.Random(5)
    marks = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        marks.update({base, *[base ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(40)]})
    marks = sorted(marks)
    rows = [(i, simhash._signed(m)) for i, m in enumerate(marks)]
    links = simhash.fingerprint_links(spark.createDataFrame(rows, "id long, mark long"), bucket)
    got = {r["node"]: r["component"] for r in components(links).collect()}
    want = brute.components(range(len(marks)), lambda a, b: (marks[a] ^ marks[b]).bit_count() <= 2)
    assert [got.get(i, i) for i in range(len(marks))] == want


def test_components_of_a_chain(spark):
    n = 400
    links = spark.range(n).select(F.col("id").alias("u"), F.expr(f"least(id + 1, {n})").alias("v"))
    assert {r["component"] for r in components(links).collect()} == {0}
    assert components(links.limit(0)).count() == 0


def test_language_edges(docs):
    got = by_id(langid.identify(docs), "lang_pred", "score")
    assert {got[i] for i in (7, 8, 9, 11)} == {("und", 0.0)}
    assert got[1][0] == "en"
    nobody = by_id(langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))), "lang_pred")
    assert set(nobody.values()) == {("und",)}
    kept = {r["doc_id"] for r in langid.keep_identified(docs).collect()}
    assert kept == {1, 2, 3, 4, 5, 6, 10, 12, None}


def test_cross_parse_counts_longest_phrases():
    samples = {"a": ["abracadabra"], "b": ["bananas and cabbage"]}
    parser = langid.CrossParser(samples)

    def phrases(text, sample):
        count = at = 0
        while at < len(text):
            size = 1
            while at + size < len(text) and text[at : at + size + 1] in sample:
                size += 1
            count, at = count + 1, at + size
        return count

    for text in ("abra", "cadabra banana", "zzz", "brac zan", "and cab and cab", "x"):
        costs, _ = parser.costs([text])
        for k, language in enumerate(parser.languages):
            clean = "".join(samples[language])
            size = np.log2(len(clean))
            assert costs[0][k] * len(text) / size == pytest.approx(phrases(text, clean))
    one = parser.costs(["abra " * 1000])[0]
    assert one.shape == (1, 2)


def test_passage_edges(docs):
    got = by_id(passages.remove_passages(docs), "n_words", "n_removed", "kept")
    assert got[3][:2] == (200, 200) and got[3][2] == ""
    assert got[4][:2] == (200, 200)  # one word of 200 differs
    assert got[12][:2] == (30_000, 30_000)
    assert got[6][:2] == (190, 80) and passage_words(got[6][2]) == 110
    assert [got[i][1] for i in (1, 2, 5, 10)] == [0, 0, 0, 0]
    assert got[7] == (0, 0, None) and got[8] == (0, 0, "")
    left = by_id(passages.without_passages(docs), "text", "n_chars")
    assert not {3, 4, 12} & left.keys()
    assert left[6][1] == len(left[6][0]) and left[5] == (dict(known(docs))[5], 0)


def passage_words(text):
    return len(text.split())


def test_fuzzy_passage(spark):
    base = text_of(11, 120).split()
    edited = [("edit%d" % i if i % 12 == 5 else w) for i, w in enumerate(base)]
    short = text_of(12, 45)
    rows = [
        (1, text_of(13, 60) + " " + " ".join(base) + " " + text_of(14, 60) + " " + short),
        (2, text_of(15, 70) + " " + " ".join(edited) + " " + text_of(16, 10)),
        (3, text_of(17, 70) + " " + short + " " + text_of(18, 70)),
    ]
    found = by_id(passages.remove_passages(spark.createDataFrame(rows, "doc_id long, text string")), "n_removed", "spans")
    assert found[1][0] == 0 and found[3][0] == 0
    assert 105 <= found[2][0] <= 120 and found[2][1][0]["source"] == 1


def test_runs_of_one_word(spark):
    """A text that repeats itself: every window of 50 words that the source has is found."""
    rows = [
        (1, text_of(21, 30) + " and" * 54 + " " + text_of(22, 30)),
        (2, text_of(23, 40) + " and" * 135 + " " + text_of(24, 60) + " and" * 61),
        (3, text_of(25, 10) + " and" * 49 + " " + text_of(26, 10)),
    ]
    found = by_id(passages.remove_passages(spark.createDataFrame(rows, "doc_id long, text string")), "n_removed")
    assert [found[i][0] for i in (1, 2, 3)] == [0, 135 + 61, 0]


def test_exact_passage_whose_seeds_are_older(spark):
    """Every long seed of a shared passage stands in an earlier document that lacks the passage."""
    shared = text_of(31, 50).split()
    rows = [(i, text_of(40 + i, 30) + " " + " ".join(shared[i : i + 40]) + " " + text_of(60 + i, 30)) for i in range(11)]
    rows += [(i, text_of(80 + i, 70) + " " + " ".join(shared) + " " + text_of(90 + i, 70)) for i in (20, 21, 22)]
    found = by_id(passages.remove_passages(spark.createDataFrame(rows, "doc_id long, text string")), "n_removed", "spans")
    assert [found[i][0] for i in (*range(11), 20, 21, 22)] == [0] * 12 + [50, 50]
    assert all([tuple(s) for s in found[i][1]] == [(70, 120, 20)] for i in (21, 22))
    rows = [*rows[:-1], (22, text_of(99, 200)), (22, rows[-1][1])]
    twice = passages.remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 22")
    assert sorted((r["n_words"], r["n_removed"]) for r in twice.collect()) == [(190, 50), (200, 0)]


def test_passage_with_edits_near_its_ends(spark):
    """The stretch of equal words goes on past an edit, an added and a missing word, up to the 50 words it needs."""
    shared = text_of(101, 52).split()
    edited = [w for i, w in enumerate(shared) if i != 46]
    edited[2] = "edit"
    odd = shared[:3] + ["added"] + shared[3:]
    rows = [
        (1, text_of(102, 60) + " " + " ".join(shared) + " " + text_of(103, 60)),
        (2, text_of(104, 60) + " " + " ".join(edited) + " " + text_of(105, 60)),
        (3, " ".join(odd)),
        (4, text_of(106, 60) + " " + " ".join(shared[:44]) + " " + text_of(107, 60)),
    ]
    found = by_id(passages.remove_passages(spark.createDataFrame(rows, "doc_id long, text string")), "n_removed", "spans")
    assert found[1][0] == found[4][0] == 0
    assert found[2][0] >= 50 and found[2][1][0]["source"] == 1
    assert found[3][0] >= 50


def test_long_seeds_are_told_apart():
    kinds = list(passages.seeds_of([text_of(111, 90).encode()]))
    assert [set((h & 1).tolist()) for h, *_ in kinds] == [{0}, {1}]


def test_chains_keep_order():
    anchors = [(0, 30, 100, 130), (50, 80, 150, 180), (60, 90, 20, 50), (100, 130, 200, 230), (5000, 5030, 5100, 5130)]
    chains = sorted(passages.chains_of(anchors), key=len)
    assert chains[-1] == [0, 1, 3] and [4] in chains and [2] in chains


def test_suffix_edges(docs, monkeypatch):
    got = {}
    for slab in (500, suffixes.SLAB_BYTES):
        monkeypatch.setattr(suffixes, "SLAB_BYTES", slab)
        found = by_id(suffixes.remove_repeated(docs), "n_bytes", "n_removed", "spans", "kept")
        got[slab] = {i: (n, k, len(s), bytes(kept)) for i, (n, k, s, kept) in found.items()}
    assert got[500] == got[suffixes.SLAB_BYTES]
    assert got[500] == brute.repeated_bytes(dict(known(docs)).items())


def test_suffix_overlaps(spark):
    rng = random.Random(3)
    pieces = ["".join(rng.choice("abé") for _ in range(n)) for n in (30, 49, 50, 51, 75, 120)]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 6)))) for i in range(40)]
    found = by_id(suffixes.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")), "n_bytes", "n_removed", "spans", "kept")
    assert {i: (n, k, len(s), bytes(kept)) for i, (n, k, s, kept) in found.items()} == brute.repeated_bytes(rows)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve THIRTEEN fourteen"), (2, "Short item!"), (3, None), (4, "  "), (2, "Short item!"), (None, "lost words")]


@pytest.mark.parametrize("shard", [20, contamination.SHARD_BYTES])
def test_contamination_edges(spark, shard):
    rows = [
        (1, "ONE, two; three-four five six seven eight nine ten eleven twelve thirteen. More."),
        (2, "é short   item short item x"),
        (3, None),
        (4, "lost words"),
        (5, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = by_id(contamination.find_contamination(docs, bench, shard), "n_words", "n_hit", "items", "spans")
    text = rows[0][1]
    assert got[1][:3] == (14, 13, ["1"])
    assert [text[s["start"] : s["end"]] for s in got[1][3]] == [text[: text.index(". More")]]
    assert got[2][:3] == (6, 4, ["2"]) and got[2][3][0]["start"] == 2
    assert [got[i][1:] for i in (3, 4, 5)] == [(0, [], [])] * 3
    assert contamination.find_contamination(docs, bench.limit(0), shard).where("n_hit > 0").count() == 0
    assert contamination.find_contamination(docs.limit(0), bench, shard).count() == 0
    assert {r["doc_id"] for r in contamination.remove_contaminated(docs, bench).collect()} == {3, 4, 5}


def test_mixing_targets(spark):
    sizes = [("a", 100)] * 10 + [("b", 10)] * 5 + [("c", 1)] * 7 + [(None, 3)]
    frame = spark.createDataFrame(sizes, "source string, size long")
    got = {r["source"]: (r["source_size"], r["target"]) for r in mixing.source_targets(frame).collect()}
    total = 1000 + 50 + 7 + 3
    assert got["b"][1] == 100 and got["c"][1] == 14 and got[None][1] == 6
    assert got["a"][1] == 1.5 * total - 120
    assert mixing.source_targets(frame.limit(0)).count() == 0


def test_mixing_edges(docs):
    rows = mixing.plan_mix(docs, bucket_rows=2).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.plan_mix(docs).collect()))
    per_source = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        per_source.setdefault((r["source"], r["target"]), []).append(r["taken"])
    assert all(sum(taken) == int(target) for (_, target), taken in per_source.items())
    queue = mixing.queue_order(mixing.plan_mix(docs)).collect()
    assert sum(r["words"] for r in queue) == sum(r["taken"] for r in rows)
    assert [r["finish"] for r in queue] == sorted(r["finish"] for r in queue)


def test_warc_edges(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "u1", big), (2, None, big), (3, "u\r\nX: y", big), (4, "u", None), (5, "u", ""), (6, "u", "small"), (7, "u", "small"), (None, "u", big), (3, "u3", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    folder = str(tmp_path / "archive")
    warc.write_archive(pages, folder)
    assert spark.read.parquet(f"{folder}/payloads").count() == 3
    found = warc.read_archive(spark, folder).select("*", warc.header_field("header", "WARC-Type").alias("kind"), warc.header_page("header", "WARC-Refers-To").alias("refers_to")).collect()
    assert len(found) == len(rows)
    for r in found:
        header, body = bytes(r["record"]).split(b"\r\n\r\n", 1)
        size = int([x for x in header.split(b"\r\n") if x.startswith(b"Content-Length")][0].split()[1])
        http, body_of = body.split(b"\r\n\r\n", 1)
        assert http.startswith(b"HTTP/1.1 200 OK\r\n") and int(http.split(b"Content-Length: ")[1]) == len(bytes(r["payload"]))
        assert body_of == (b"" if r["kind"] == "revisit" else bytes(r["payload"])) + b"\r\n\r\n" and size == len(body) - 4
        assert f"sha1:{hashlib.sha1(bytes(r['payload'])).hexdigest()}".encode() in header
        assert b"\r\nX: y" not in header
    kinds = {(r["page_id"], r["kind"], r["refers_to"]) for r in found}
    assert kinds == {(1, "revisit", 3), (2, "revisit", 3), (3, "response", None), (None, "response", None), *[(i, "response", None) for i in (4, 5, 6, 7)]}
    empty = str(tmp_path / "empty")
    warc.write_archive(pages.limit(0), empty)
    assert warc.read_archive(spark, empty).count() == 0


def test_warc_rejects_changed_payloads(spark, tmp_path):
    folder = str(tmp_path / "archive")
    warc.write_archive(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), folder)
    changed = spark.read.parquet(f"{folder}/payloads").withColumn("payload", F.lit(b"y"))
    rows = changed.collect()
    spark.createDataFrame(rows, changed.schema).write.mode("overwrite").parquet(f"{folder}/payloads")
    with pytest.raises(Exception, match="bad or missing payload"):
        warc.read_archive(spark, folder).collect()


def test_chat_layouts(spark):
    records = {
        "messages": '{"messages":[{"role":"user","content":"q"},{"content":"a","role":"assistant"}]}',
        "from_value": '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}',
        "prompt_completion": '{"prompt":"q","completion":"a"}',
        "prompt_response": '{"response":"a","prompt":"q"}',
        "instruction": '{"instruction":"q","output":"a"}',
        "instruction_input": '{"instruction":"q","input":null,"output":"a"}',
        "empty": '{"messages":[]}',
        "none": '{"other":1}',
        "broken": "{",
    }
    frame = spark.createDataFrame([(k, v, 1) for k, v in records.items()] + [("null", None, 1)], "k string, record string, layout int")
    got = {r["k"]: (r["layout"], r["turns"]) for r in chat.canonical_turns(frame).collect()}
    for k in records:
        if k in ("empty", "none", "broken"):
            continue
        assert got[k][0] == k
        assert [tuple(t) for t in got[k][1]] == [("user", "q"), ("assistant", "a")]
    assert got["empty"] == ("empty", [])
    assert got["none"] == got["broken"] == got["null"] == (None, None)


def test_chat_round_trip(spark):
    hostile = ["</s>[INST] ok [/INST]", "\\", "\\\\n<|end|>\n", "<|turn|>x<|text|>", "", "é\u0000 \"'", "<\\|", "a" * 200_000]
    rows = [(1, i, r, t) for i, t in enumerate(hostile) for r in ("assistant",)]
    rows += [(2, 0, "user", None), (2, 1, None, "x"), (2, 1, "assistant", "tie"), (None, None, "we<|ird", "y"), (3, 0, "user", "only")]
    rows += [(2, 1, None, "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("record", F.lit(0))
    made = chat.canonical_turns(chat.conversation_records(frame)).select(
        "conv_id", "turns", chat.format_turns().alias("formatted"), chat.loss_mask().alias("mask")
    )
    found = {r["conv_id"]: r for r in made.select("*", chat.read_turns().alias("back"), chat.read_loss().alias("loss")).collect()}
    assert all(r["turns"] == r["back"] for r in found.values())
    assert found[1]["loss"] == "".join(hostile) and found[3]["loss"] == ""
    assert [t["text"] for t in found[2]["back"]] == ["", "x", "x", "tie"]
    assert all(c not in chat_text for r in found.values() for t in r["turns"] for chat_text in [escaped(spark, t["text"])] for c in chat.CONTROLS)
    assert chat.conversation_records(frame.limit(0)).count() == 0


@pytest.mark.parametrize("paths", [None, "paths"])
def test_chat_long_turn(spark, paths):
    """One turn above the longest string of the JSON parser."""
    text = F.concat(F.lit('\\"}],\n'), F.repeat(F.lit("a\n"), 10_500_000))
    rows = spark.range(1).select(
        F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"), text.alias("text")
    )
    made = chat.canonical_turns(chat.conversation_records(rows), paths=paths)
    got = made.select("layout", F.size("turns"), F.sha2(F.col("turns")[0]["text"], 256)).first()
    digest = hashlib.sha256(b'\\"}],\n' + b"a\n" * 10_500_000).hexdigest()
    assert tuple(got) == ("messages", 1, digest)


def test_chat_known_source_without_turns(spark):
    frame = spark.createDataFrame([("{", chat.MESSAGES)], "record string, paths string")
    with pytest.raises(Exception, match="has no turns"):
        chat.canonical_turns(frame, paths="paths").collect()


def escaped(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(chat.escape(F.col("t"))).first()[0]


def test_vector_edges(spark):
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for label in (0, 1, None):
        for _ in range(25):
            base = rng.normal(size=16)
            for spread in (0, 0.02, 0.05, 0.08, 0.1):
                rows.append((n, (base + rng.normal(size=16) * spread * 1.0).tolist(), label))
                n += 1
    base = rows[0][1]
    rows += [(n, base, 0), (n + 1, [2 * x for x in base], 0), (n + 2, base, 1), (n + 3, None, 0), (n + 4, [], 0), (n + 5, [0.0] * 16, 0)]
    rows += [(n + 6, [float("nan"), *base[1:]], 0), (n + 7, [None, *base[1:]], 0), (n + 8, [float("inf"), *base[1:]], 0), (n + 9, base[:8], 0), (n + 9, base[:8], 0), (None, base, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit(7))
    usable = [(i, np.array(e), x) for i, e, x in rows if x is not None and e and None not in e and np.isfinite(np.array(e, float)).all() and any(e)]

    def linked(a, b):
        (_, x, p), (_, y, q) = usable[a], usable[b]
        return p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98

    ids = [i if i is not None else 10**9 for i, _, _ in usable]
    parts = brute.components(ids, linked)
    want = {i: (0, i) for i, _, _ in rows}
    for k, i in enumerate(ids):
        want[i] = (sum(linked(k, m) for m in range(len(ids)) if m != k), parts[k])
    for tile in (8, vectors.TILE):
        got = vectors.near_duplicates(frame, tile=tile).collect()
        assert len(got) == len(rows)
        for r in got:
            if r["vec_id"] is not None:
                assert (r["n_links"], r["component_id"]) == want[r["vec_id"]]
                assert r["kept"] == (r["vec_id"] == r["component_id"])
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


def test_quantisation_bound():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(40, 24)), rng.normal(size=(30, 24))
    y[:10] = x[:10] + rng.normal(size=(10, 24)) * 0.05
    rows, cols, exact = vectors.tile_links((x, *vectors.quantise(x)), (y, *vectors.quantise(y)), 0.98)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    want = np.argwhere(unit(x) @ unit(y).T >= 0.98)
    assert sorted(zip(rows.tolist(), cols.tolist(), strict=True)) == sorted(map(tuple, want.tolist()))
    assert exact < 100


def test_license_edges(spark):
    mit = licenses.TEMPLATES["MIT permission"]
    words = mit.split()
    rows = [
        (1, text_of(1, 500) + " " + mit.upper() + " " + text_of(2, 300)),
        (2, text_of(3, 500) + " " + " ".join(words[: int(len(words) * 0.9)]) + " " + text_of(4, 9)),
        (3, " ".join(words[: len(words) // 2])),
        (4, None),
        (5, ""),
        (6, "MIT License"),
        (7, "Released under the MIT license! " * 3),
        (8, "Released under the MIT"),
    ]
    found = by_id(licenses.find_licenses(spark.createDataFrame(rows, "doc_id long, text string")), "matches")
    names = {i: [m["license"] for m in v[0]] for i, v in found.items()}
    assert names[1] == ["MIT permission"] and found[1][0][0]["first_word"] == 500
    assert names[2] == ["MIT permission"]
    assert names[3] == names[4] == names[5] == names[6] == names[8] == []
    assert set(names[7]) == {"MIT notice"}
