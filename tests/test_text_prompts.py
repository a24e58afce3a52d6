import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from traceflow.functions import parsing
from traceflow.functions.features import model_inputs, truncate_steps
from traceflow.functions.text import pieces, strip, words
from traceflow.operators import packing, prompts, scoring, vocabulary

SEQ = (
    "student_id long, n int, chunk long, question_ids array<long>, questions array<string>, "
    "kcs array<string>, difficulties array<int>, answers array<int>"
)


@pytest.fixture
def enriched(spark):
    row = (1, 3, 0, [4, 5, 6], ["it's", 'say "x"', "a\nb"], ["9", "8", "7"], [1, 2, 3], [1, 0, 1])
    return spark.createDataFrame([row], SEQ)


def plain(prompt):
    return [(m["role"], m["content"]) for m in prompt]


def test_prompt_shape(enriched):
    row = prompts.build_prompts(enriched, incl_id=False, incl_q=False).first()
    assert plain(row["prompt"]) == [
        ("assistant", prompts.INSTRUCTION_WITH_KC),
        ("user", "Topic: 9, Difficulty: 1"),
        ("assistant", "CORRECT"),
        ("user", "Topic: 8, Difficulty: 2"),
        ("assistant", "WRONG"),
        ("user", "Topic: 7, Difficulty: 3"),
    ]
    assert row["gt"] == "CORRECT"


def test_prompt_flags(enriched):
    row = prompts.build_prompts(enriched, incl_kc=False, incl_diff=False).first()
    assert row["prompt"][0]["content"] == prompts.INSTRUCTION
    assert row["prompt"][1]["content"] == "ID: 4, Question: it's, "
    row = prompts.build_prompts(
        enriched, False, False, False, True, instruction_role="system"
    ).first()
    assert plain(row["prompt"])[:2] == [
        ("system", prompts.INSTRUCTION), ("user", "Difficulty: 1")
    ]


def test_prompt_without_steps(spark):
    df = spark.createDataFrame([(1, 3, 0, [], [], [], [], [])], SEQ)
    row = prompts.build_prompts(df).first()
    assert len(row["prompt"]) == 1 and row["gt"] is None


def test_prompt_text_is_a_python_list(enriched):
    df = prompts.build_prompts(enriched).withColumn("text", prompts.prompt_text("prompt"))
    row = df.first()
    assert row["text"] == str([m.asDict() for m in row["prompt"]])


def test_budget(enriched):
    df = prompts.build_prompts(enriched)
    text = df.select(prompts.prompt_text("prompt")).first()[0]
    size = len(re.findall(r"\w+|[^\w\s]", text))
    assert prompts.within_budget(df, size).count() == 1
    assert prompts.within_budget(df, size - 1).count() == 0
    counter = prompts.token_counter(len)
    assert prompts.within_budget(df, len(text), counter).first()["tokens"] == len(text)
    assert prompts.within_budget(df, len(text) - 1, counter).count() == 0


def test_training_line(spark):
    df = spark.createDataFrame([([1, 2], [1, 0])], "difficulties array<int>, answers array<int>")
    assert prompts.training_lines(df).first()["line"] == (
        "Difficulty: 1 -> Answer: CORRECT ||| Difficulty: 2 -> Answer: WRONG"
    )


def test_scoring(enriched):
    df = prompts.build_prompts(enriched).select("student_id", "prompt", "gt")
    found = scoring.score_prompts(df, scoring.previous_answer).first()
    assert (found["pred"], found["gt"]) == ("WRONG", "CORRECT")

    def broken(messages):
        raise OSError("no answer")

    assert scoring.score_prompts(df, broken, retries=2, pause=0).first()["pred"] is None


def test_flaky_scorer_is_asked_again(enriched):
    calls = []

    def flaky(messages):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("try again")
        return "CORRECT"

    df = prompts.build_prompts(enriched).select("prompt")
    assert scoring.score_prompts(df, flaky, retries=2, pause=0).first()["pred"] == "CORRECT"


def test_tolerant_int(spark):
    texts = ["3", " 5 ", "3.0", "x", "1_000", "1__0", "-7", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in df.select(parsing.tolerant_int("t")).collect()]
    assert found == [3, 5, -1, -1, 1000, -1, -7, -1, -1]
    numbers = spark.createDataFrame([(3.7,), (-2.5,), (float("nan"),)], "x double")
    assert [r[0] for r in numbers.select(parsing.tolerant_int("x")).collect()] == [3, -2, -1]


def test_flags_and_words(spark):
    df = spark.createDataFrame([("true",), ("False",), ("maybe",), (None,)], "t string")
    assert [r[0] for r in df.select(parsing.flag("t")).collect()] == [1, 0, None, None]
    df = spark.createDataFrame([(1,), (0,), (None,)], "a int")
    assert [r[0] for r in df.select(parsing.answer_word("a")).collect()] == [
        "CORRECT", "WRONG", None
    ]
    df = spark.createDataFrame([("CORRECT",), ("Correct.",), (None,)], "w string")
    assert [r[0] for r in df.select(parsing.word_flag("w")).collect()] == [1, 0, 0]


def test_padding(spark):
    df = spark.createDataFrame([([1, 0, -1],), ([1, 0],)], "answers array<int>")
    assert rows_of(df.where(~parsing.is_padded("answers"))) == [([1, 0],)]
    texts = spark.createDataFrame([(["1", "-1"],)], "answers array<string>")
    assert texts.where(~parsing.is_padded(parsing.tolerant_ints("answers"))).count() == 0


def test_features(spark):
    df = spark.createDataFrame(
        [([1, 2, 3], [1, 0, 1], [9, 8, 7])],
        "difficulties array<int>, answers array<int>, kc_ids array<long>",
    )
    row = model_inputs(df).first()
    assert row["features"] == [[1, 1], [2, 0], [3, 0]] and row["label"] == 1
    assert list(row["vector"]) == [1, 1, 2, 0, 3, 0]
    assert model_inputs(df, with_kc=True).first()["features"] == [[1, 9, 1], [2, 8, 0], [3, 7, 0]]
    short = model_inputs(df, seq_len=2).first()
    assert short["features"] == [[1, 1], [2, 0]] and short["label"] == 0
    with pytest.raises(Exception, match="shorter than 4"):
        model_inputs(df, seq_len=4).collect()
    assert truncate_steps(df, 4, ["answers"], short="drop").count() == 0


def test_features_with_holes(spark):
    df = spark.createDataFrame([([1, 2], [1, None])], "difficulties array<int>, answers array<int>")
    with pytest.raises(Exception, match="missing value"):
        model_inputs(df).collect()
    assert model_inputs(df, missing="drop").count() == 0


def test_words_and_vocabulary(spark):
    text = "Étion 4x_y étion"
    df = spark.createDataFrame([(1, text), (2, "b étion"), (3, "")], "doc_id long, text string")
    assert df.select(words("text")).first()[0] == ["étion", "4x_y", "étion"]
    assert rows_of(vocabulary.vocabulary(df)) == [
        (1, "4x_y", 1), (1, "étion", 0), (2, "b", 0), (2, "étion", 1)
    ]
    assert rows_of(vocabulary.word_counts(df)) == [
        ("4x_y", 1, 1, 1), ("b", 1, 2, 0), ("étion", 3, 1, 0)
    ]


def test_strip_matches_python(spark):
    texts = ["  a b \n", "\x85x\xa0", "\x1cq", "plain", " \t\r\n", "​y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(strip("t")).collect()] == [t.strip() for t in texts]


@pytest.mark.parametrize("bounded", [True, False])
def test_mean_vectors(spark, monkeypatch, bounded):
    monkeypatch.setattr(vocabulary, "fits_broadcast", lambda table: bounded)
    docs = spark.createDataFrame([(1, "a a b"), (2, "b zz")], "doc_id long, text string")
    vectors = spark.createDataFrame(
        [(97, [1.0, 0.0]), (98, [4.0, 3.0])], "vec_id long, embedding array<float>"
    )
    found = vocabulary.mean_vectors(docs, vectors, lambda w: F.ascii(w).cast("long"))
    assert rows_of(found) == [(1, [2.0, 1.0]), (2, [4.0, 3.0])]


@pytest.mark.parametrize("bounded", [True, False])
def test_mean_vectors_meet_in_blocks(spark, monkeypatch, bounded):
    """Vectors move by block, not once per word; ids may repeat or be missing on both sides."""
    monkeypatch.setattr(vocabulary, "fits_broadcast", lambda table: bounded)
    monkeypatch.setattr(vocabulary, "BLOCK_BYTES", 40, raising=False)
    monkeypatch.setattr(vocabulary, "SLICE_BYTES", 10, raising=False)
    docs = [(i, " ".join("abcdefgz"[(i * j) % 8] for j in range(i % 23))) for i in range(60)]
    docs += [(5, "a b"), (None, "a"), (70, None), (71, "z")]
    table = [(97 + i, [float(i), float(i * i)]) for i in range(7)] + [(97, [7.0, 1.0]), (None, [1.0, 2.0])]
    found = vocabulary.mean_vectors(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(table, "vec_id long, embedding array<float>"),
        lambda w: F.ascii(w).cast("long"),
    )
    want = []
    for i, _ in docs:
        known = [v for j, t in docs if i is not None and j == i for w in (t or "").split() for k, v in table if k == ord(w)]
        want.append((i, [sum(c) / len(known) for c in zip(*known, strict=True)] if known else None))
    order = lambda r: (r[0] is None, r[0] or 0)
    got = sorted(((r[0], r[1]) for r in found.collect()), key=order)
    assert [g[0] for g in got] == [w[0] for w in sorted(want, key=order)]
    for g, w in zip(got, sorted(want, key=order), strict=True):
        assert g[1] == (None if w[1] is None else pytest.approx(w[1], abs=1e-12))
    plan = found._jdf.queryExecution().toString()
    if bounded:
        # One exchange of texts by their id serves counts and sums, another one the ids that the means go to.
        physical = plan[plan.index("== Physical Plan ==") :].split("== Initial Plan ==")[0]
        assert physical.count("Exchange hashpartitioning") <= 2
    else:
        assert "FlatMapCoGroupsInArrow" in plan


@pytest.mark.parametrize("size", [1, 7, 128])
def test_packing_against_loop(spark, size):
    import hashlib

    texts = {i: " ".join(f"w{i}_{j}" for j in range((i * 13) % 40)) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    order = sorted(texts, key=lambda i: hashlib.md5(f"1:{i}".encode()).hexdigest())
    stream = [w for i in order for w in texts[i].split()]
    expected = [
        (b, stream[b * size : (b + 1) * size]) for b in range(len(stream) // size)
    ]
    found = packing.pack_blocks(df, ["doc_id"], block_size=size)
    assert sorted((r["block"], r["tokens"]) for r in found.collect()) == expected


def test_pieces(spark):
    df = spark.createDataFrame([("Hi, it's 3.5!",)], "t string")
    assert df.select(pieces("t")).first()[0] == ["Hi", ",", "it", "'", "s", "3", ".", "5", "!"]
