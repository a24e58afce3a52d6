from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.conftest import ATTEMPT_SCHEMA, rows_of
from traceflow.operators import history, splits
from traceflow.operators.lookups import one_kc, with_kc, enrich_steps

MIXED = [1, 0, 1, 1, 0, 1, 0, 0, 1, 1, 0]


def brute_sequences(histories, n, drop_full_tail=True):
    """Chunk numbers per student, written as a plain loop over lists."""
    kept = []
    for student, answers in histories.items():
        for start in range(0, len(answers), n):
            if start + n > len(answers) or (drop_full_tail and start + n == len(answers)):
                break
            part = answers[start : start + n]
            if part.count(0) == n or part.count(1) == n:
                continue
            kept.append((student, start // n))
    return sorted(kept)


def test_tail_rule(make_attempts, questions):
    histories = {k: MIXED[:k] for k in (4, 5, 6, 10, 11)}
    found = history.sequences(make_attempts(histories), questions, (5,))
    assert rows_of(found, "student_id", "chunk") == [(6, 0), (10, 0), (11, 0), (11, 1)]
    full = history.sequences(make_attempts(histories), questions, (5,), drop_full_tail=False)
    assert rows_of(full, "student_id", "chunk") == brute_sequences(histories, 5, False)


def test_uniform_chunks_are_dropped(make_attempts, questions):
    histories = {1: [1] * 5 + [0], 2: [0] * 5 + [0], 3: [1, 1, 1, 0, 1, 0]}
    found = history.sequences(make_attempts(histories), questions)
    assert rows_of(found, "student_id") == [(3,)]


def test_missing_answer_keeps_chunk(make_attempts, questions):
    histories = {1: [1, 1, 1, 1, None, 0], 2: [0, 0, 0, 0, None, 0]}
    found = history.sequences(make_attempts(histories), questions)
    assert rows_of(found, "student_id") == [(1,), (2,)]


def test_duplicates(make_attempts, questions):
    part, other = [1, 0, 1, 1, 0], [0, 0, 0, 0, 1]
    numbers = [1, 2, 3, 4, 5] * 3 + [6]
    histories = {1: part + other + part + [0], 2: part + [0]}
    asked = {1: numbers, 2: numbers}
    found = history.sequences(make_attempts(histories, questions=asked), questions)
    assert rows_of(found, "student_id", "chunk") == [(1, 0), (1, 1), (2, 0)]
    hints = {1: [None] + [0] * 9 + [None] + [0] * 5, 2: [0] * 6}
    found = history.sequences(make_attempts(histories, hints, asked), questions)
    assert rows_of(found, "student_id", "chunk") == [(1, 0), (1, 1), (1, 2), (2, 0)]


def test_time_ties_and_missing_time(spark):
    when = datetime(2024, 1, 1)
    rows = [
        (1, 1, 1, 0, None, 0),
        (1, 2, 1, 0, when, 3),
        (1, 3, 1, 0, when, 2),
        (None, 4, 1, 0, when, 4),
    ]
    found = history.history_positions(spark.createDataFrame(rows, ATTEMPT_SCHEMA))
    assert rows_of(found, "question_id", "pos", "history_len") == [(1, 2, 3), (2, 1, 3), (3, 0, 3)]


def test_unknown_question(make_attempts, questions):
    odd = {1: [1, 2, 3, 4, 999, 6]}
    uniform = make_attempts({1: [1, 1, 1, 1, 1, 1]}, questions=odd)
    assert history.sequences(uniform, questions).count() == 0
    mixed = make_attempts({1: [1, 0, 1, 1, 1, 1]}, questions=odd)
    with pytest.raises(Exception, match="unknown question"):
        history.sequences(mixed, questions).collect()
    assert history.sequences(mixed, questions, unknown="drop").count() == 0


def test_known_question_without_difficulty(spark, make_attempts):
    table = spark.createDataFrame(
        [(i, None if i == 2 else 1) for i in range(1, 7)], "id long, difficulty int"
    )
    found = history.sequences(make_attempts({1: [1, 0, 1, 1, 1, 1]}), table)
    assert found.first()["difficulties"] == [1, None, 1, 1, 1]


def _histories():
    return {s: [(i * i + s + i // 3) % 2 for i in range(20 + 7 * s)] for s in range(1, 8)}


@pytest.mark.parametrize("n", [2, 5, 10])
def test_against_loop(make_attempts, questions, n):
    found = history.sequences(make_attempts(_histories()), questions, (n,), dedup=False)
    assert rows_of(found, "student_id", "chunk") == brute_sequences(_histories(), n)


@pytest.mark.parametrize("hot_rows", [1, 50])
def test_hot_students_give_the_same(make_attempts, questions, hot_rows):
    attempts = make_attempts(_histories())
    expected = history.history_positions(attempts)
    found = history.history_positions(attempts, hot_rows=hot_rows)
    columns = ["student_id", "seq", "pos", "history_len"]
    assert rows_of(found, *columns) == rows_of(expected, *columns)
    split = splits.student_split(attempts)
    plain = history.sequences(attempts, questions, (5, 10), split)
    hot = history.sequences(attempts, questions, (5, 10), split, hot_rows=hot_rows)
    assert rows_of(hot, *plain.columns) == rows_of(plain)


def test_hot_student_with_equal_times(spark):
    when = datetime(2024, 1, 1)
    rows = [(1, 1, 1, 0, when, (i * 37) % 500) for i in range(500)] + [(2, 1, 1, 0, when, 900)]
    found = history.history_positions(spark.createDataFrame(rows, ATTEMPT_SCHEMA), hot_rows=10)
    assert found.where("student_id = 1 AND pos != seq").count() == 0
    assert found.where("student_id = 1").count() == 500


@pytest.mark.parametrize("partitions", ["1", "200"])
def test_partitions_and_order_do_not_matter(spark, make_attempts, questions, partitions):
    attempts = make_attempts(_histories())
    split = splits.student_split(attempts)
    expected = rows_of(history.sequences(attempts, questions, (5,), split))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        mixed = attempts.orderBy(F.md5(F.col("seq").cast("string"))).repartition(7)
        found = history.sequences(mixed, questions, (5,), splits.student_split(mixed))
        assert rows_of(found) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


KC_ROWS = [(326, 17, 10), (327, 17, 12), (1, 1, 5), (9, 2, 6), (4, 2, 7)]


def test_first_and_last_topic(spark):
    relation = spark.createDataFrame(
        KC_ROWS, "id long, question_id long, knowledgecomponent_id long"
    )
    assert rows_of(one_kc(relation, "first")) == [(1, 5), (2, 7), (17, 10)]
    assert rows_of(one_kc(relation, "last")) == [(1, 5), (2, 6), (17, 12)]


def test_step_lookups(spark, make_attempts, questions):
    attempts = make_attempts({1: [1, 0, 1, 1, 0, 1]}, questions={1: [1, 2, 1, 3, 2, 4]})
    found = history.sequences(attempts, questions)
    topics = spark.createDataFrame(
        [(1, 11), (2, 12), (3, 13)], "question_id long, kc_id long"
    )
    for options in ({}, {"max_rows": 0, "hot_rows": 0}):
        assert with_kc(found, topics, **options).first()["kc_ids"] == [11, 12, 11, 13, 12]
    known = questions.where("id != 2")
    for options in ({}, {"max_rows": 0, "hot_rows": 0}):
        row = enrich_steps(found, known, topics, **options).first()
        assert row["question_ids"] == [1, 1, 3]
        assert row["questions"] == ["question 1", "question 1", "question 3"]
        assert row["kcs"] == ["11", "11", "13"]
        assert row["answers"] == [1, 1, 1]
    with pytest.raises(Exception, match="without a topic"):
        with_kc(found, topics.where("question_id != 3")).collect()
    assert with_kc(found, topics.where("question_id != 3"), unknown="drop").count() == 0


def test_first_row_of_a_question_wins(spark, make_attempts):
    rows = [(i, 1 if i != 2 else 3, "t", 10 + i) for i in range(1, 7)] + [(2, 2, "t", 5)]
    table = spark.createDataFrame(
        rows, "id long, difficulty int, question_rich_text string, row long"
    )
    attempts = make_attempts({1: [1, 0, 1, 1, 1, 1]})
    found = history.with_difficulty(attempts, table, ("row",)).where("question_id = 2")
    assert found.first()["difficulty"] == 2
