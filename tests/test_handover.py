"""From files to prompts and models, and the rules for rows that would get lost."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from traceflow.functions import parsing
from traceflow.operators import history, joins, lookups, metrics, models, prompts, slices, splits
from traceflow.sources import readers, writers

QUESTIONS = [(i, i % 3 + 1, f"Q{i}") for i in range(1, 7)]


@pytest.fixture
def sequence_file(spark, tmp_path):
    path = tmp_path / "test_n_3.json"
    record = '{"student_id": 1, "question_ids": %s, "answers": [1, 0, 1], "difficulties": [1, 2, 3], "hint_used": [0, 0, 0]}'
    path.write_text("[" + record % [1, 2, 3] + ",\n" + record % [4, 5, 6] + "]")
    return readers.read_sequence_file(spark, str(path))


def tables(spark):
    questions = spark.createDataFrame(QUESTIONS, "id long, difficulty int, question_rich_text string")
    topics = spark.createDataFrame([(q, 10 * q) for q, _, _ in QUESTIONS], "question_id long, kc_id long")
    return questions, topics


def test_sequence_file_to_prompts(spark, sequence_file):
    questions, topics = tables(spark)
    enriched = lookups.enrich_steps(sequence_file, questions, topics)
    assert rows_of(enriched, "student_id", "n", "chunk", "question_ids", "kcs") == [
        (1, 3, 0, [1, 2, 3], ["10", "20", "30"]),
        (1, 3, 1, [4, 5, 6], ["40", "50", "60"]),
    ]
    assert rows_of(lookups.with_kc(sequence_file, topics), "chunk", "kc_ids") == [(0, [10, 20, 30]), (1, [40, 50, 60])]
    assert prompts.build_prompts(enriched).count() == 2
    with pytest.raises(ValueError, match="chunk"):
        lookups.with_kc(sequence_file.drop("chunk"), topics)


def test_unknown_questions_keep_the_sequence(spark, sequence_file):
    questions, topics = tables(spark)
    found = lookups.enrich_steps(sequence_file, questions.where("id = 2"), topics)
    assert rows_of(found, "chunk", "question_ids", "answers") == [(0, [2], [0]), (1, [], [])]


def test_written_sequences_to_grid(spark, make_attempts, tmp_path):
    histories = {s: [(s + i) % 3 % 2 for i in range(12)] for s in range(1, 25)}
    log = make_attempts(histories)
    questions = spark.createDataFrame([(i, i % 3 + 1) for i in range(1, 13)], "id long, difficulty int")
    labelled = history.sequences(log, questions, (5,), splits.student_split(log))
    writers.write_sequences(labelled, str(tmp_path / "out"))
    read = readers.read_sequences(spark, str(tmp_path / "out"))
    cells = models.grid((5,), (1,), ("linear",))
    columns = ("split", "sup_0", "sup_1")
    log_read = models.run_grid(read, cells)
    assert rows_of(log_read, *columns) == rows_of(models.run_grid(labelled, cells), *columns)
    assert all(r["loss"] > 0 for r in log_read.collect())
    scored = models.fit_and_predict(read, 5, balance=True)
    assert scored.count() == labelled.where(splits.in_test()).count()


def test_repeated_questions_need_an_order(spark, make_attempts):
    log = make_attempts({1: [1, 0, 1, 0, 1, 1]})
    rows = [(i, 1, 2) for i in range(1, 7)] + [(1, 3, 1)]
    questions = spark.createDataFrame(rows, "id long, difficulty int, line int")
    found = history.sequences(log, questions, (5,), question_order=("line",)).first()
    assert found["difficulties"] == [3, 1, 1, 1, 1]
    with pytest.raises(Exception, match="occurs twice"):
        history.sequences(log, questions, (5,)).collect()


def test_missing_values_are_refused_or_dropped(spark):
    rows = [(1, [1, None, 3], [1, 0, 1]), (2, [1, 2, 3], [1, None, 1]), (3, [1, 2, 3], [1, 0, 1])]
    frame = spark.createDataFrame(rows, "student_id long, difficulties array<int>, answers array<int>")
    assert rows_of(prompts.training_lines(frame, "drop"), "student_id") == [(3,)]
    for broken in (1, 2):
        with pytest.raises(Exception, match="missing value"):
            prompts.training_lines(frame.where(F.col("student_id") == broken)).collect()


def test_labels_without_prediction_are_counted(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "k int, label int")
    rows = metrics.pair_predictions(labels, spark.createDataFrame([(1, 1)], "k int, pred int"), "k")
    assert rows.count() == 3
    assert metrics.unpaired(rows).first().asDict() == {"n_unpaired": 2, "n_unlabelled": 0}


def test_only_two_words_are_flags(spark):
    frame = spark.createDataFrame([(t,) for t in ("TRUE", "false", "yes", "1", "no", "t", None)], "t string")
    assert [r[0] for r in frame.select(parsing.flag("t")).collect()] == [1, 0, None, None, None, None, None]
    numbers = spark.createDataFrame([(1, True), (0, False), (2, None)], "n int, b boolean")
    assert [tuple(r) for r in numbers.select(parsing.flag("n"), parsing.flag("b")).collect()] == [(1, 1), (0, 0), (None, None)]


def test_bad_ids_are_loud(spark):
    raw = spark.createDataFrame([("u7", "1", "True", "False", "never")], "student_id string, question_id string, answer_state string, hint_used string, start_time string")
    assert readers.unread_times(raw).first()["n_unread"] == 1
    with pytest.raises(Exception, match="u7"):
        readers.parse_attempts(raw, None).collect()


def test_slices_agree_on_ties(spark):
    rows = spark.createDataFrame([(k % 2, k // 3, "x") for k in range(40)] + [(1, 13, "x")] * 3, "k int, v int, t string")
    for start, stop in ((0, 7), (5, 30), (19, 22), (38, 99)):
        small = slices.position_slice(rows, ["k"], start, stop)
        assert rows_of(small) == rows_of(slices.position_slice(rows, ["k"], start, stop, top_rows=0))
    for cut in (-1, -4, -43, -100):
        assert slices.leading_slice(rows, ["k"], cut, compat=True).count() == max(0, 43 + cut)


def test_salts_grow_with_the_key(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 700, 1).otherwise(F.col("id")).alias("k"), "id")
    lookup = spark.createDataFrame([(1, "a"), (701, "b")], "k long, name string")
    for hot_rows in (10, 100, 10**6):
        joined = joins.salted_join(rows, lookup, "k", "left", ["id"], hot_rows)
        assert joined.count() == 1000 and joined.where("name = 'a'").count() == 700
    hot = joins.hot_keys(rows, "k", 100).collect()
    assert [tuple(r) for r in hot] == [(1, 700)]
    assert joins.hot_keys(rows, "k", 700) is None


def test_folds_are_views_of_the_blocks(spark, make_attempts, tmp_path):
    """Files that hold every sequence once give what the directories of all folds give, from a third of the rows."""
    histories = {s: [(s + i) % 3 % 2 for i in range(12)] for s in range(1, 41)}
    log = make_attempts(histories)
    questions = spark.createDataFrame([(i, i % 3 + 1) for i in range(1, 13)], "id long, difficulty int")
    labelled = history.sequences(log, questions, (5, 10), splits.student_split(log))
    spread, once = str(tmp_path / "spread"), str(tmp_path / "once")
    writers.write_sequences(labelled, spread)
    writers.write_blocks(labelled, once)
    assert spark.read.parquet(once).count() == labelled.count()
    kept = labelled.where(~splits.in_test()).count()
    assert spark.read.parquet(spread).count() == 3 * kept + labelled.count() - kept
    for fold in (1, 2, 3):
        for split in (None, "train", "val", "test"):
            for n in (None, 5):
                seen = readers.read_fold(spark, once, fold, split, n)
                want = readers.read_sequences(spark, spread, n, split, fold)
                assert seen.columns == want.columns and rows_of(seen) == rows_of(want)
                assert split is None or seen.count() > 0
    # Conditions become partition filters, and files of other blocks are not opened.
    view = readers.read_fold(spark, once, 2, "val", 5)
    seen = rows_of(view)
    for broken in (*Path(once).glob("n=*/block=[02t]*/*.parquet"), *Path(once).glob("n=10/block=1/*.parquet")):
        broken.write_bytes(b"no Parquet")
        broken.with_name(f".{broken.name}.crc").unlink()
    assert rows_of(view) == seen
    with pytest.raises(Exception, match="not a Parquet file"):
        readers.read_fold(spark, once, 2, "val").count()
    plan = view._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(n" in plan and "(block#" in plan.partition("PartitionFilters")[2].partition("]")[0]
    with pytest.raises(ValueError, match="split"):
        readers.read_fold(spark, once, 1, "validation")
    with pytest.raises(Exception, match="no block"):
        writers.write_blocks(labelled.withColumn("block", F.lit(None).cast("string")), str(tmp_path / "bad"))
