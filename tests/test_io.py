import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from traceflow.operators import history, lookups, splits, stats
from traceflow.schemas import RUN_LOG
from traceflow.sources import readers, writers

LOG = """id,extra,student_id,question_id,answer_state,hint_used,start_time
11,x,7,1,true,false,2020-03-01 10:00:00.500
10,y,7,2,false,true,2020-03-01 10:00:00+00:00
12,z,8,3,maybe,,not a time
"""


@pytest.fixture
def labelled(make_attempts, questions):
    attempts = make_attempts({s: [1, 0, 1, 1, 0, s % 2, 1, 0] * 3 for s in range(1, 21)})
    return history.sequences(attempts, questions, (5, 10), splits.student_split(attempts))


def test_attempt_log(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text(LOG)
    df = readers.read_attempts(spark, str(path))
    assert df.columns == ["student_id", "question_id", "answer", "hint", "start_time", "seq"]
    assert rows_of(df, "seq", "student_id", "answer", "hint") == [
        (10, 7, 0, 1), (11, 7, 1, 0), (12, 8, None, None)
    ]
    assert rows_of(df.where("start_time is null"), "seq") == [(12,)]
    placed = history.history_positions(df.where("student_id = 7"))
    assert rows_of(placed, "pos", "seq") == [(0, 10), (1, 11)]
    hashed = readers.read_attempts(spark, str(path), seq=None)
    assert hashed.select("seq").distinct().count() == 3


def test_column_order_of_a_file_does_not_matter(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('difficulty,note,id,question_rich_text\n2,n,5,"say ""hi""\nagain"\n')
    assert rows_of(readers.read_questions(spark, str(path))) == [(5, 2, 'say "hi"\nagain')]


def test_multi_line_topics(spark, tmp_path):
    path = tmp_path / "kcs.csv"
    path.write_text('"id","name","description"\n1,One,"two\nlines"\n2,Two,plain\n')
    assert readers.read_kcs(spark, str(path)).count() == 2


@pytest.mark.parametrize("options", [{}, {"max_rows": 0, "hot_rows": 0}])
def test_topic_link_round_trip(spark, tmp_path, options):
    (tmp_path / "kcs.csv").write_text('id,name,description\n1,One,"a ""b""\nc"\n2,Two,d\n')
    (tmp_path / "rel.csv").write_text(
        "id,question_id,knowledgecomponent_id\n1,10,2\n2,10,1\n3,11,9\n4,12,2\n"
    )
    link = lookups.kc_link(
        readers.read_question_kc(spark, str(tmp_path / "rel.csv")),
        readers.read_kcs(spark, str(tmp_path / "kcs.csv")),
        **options,
    )
    columns = ["question_id", "kc_id", "name", "description"]
    expected = [(10, 1, "One", 'a "b"\nc'), (10, 2, "Two", "d"), (12, 2, "Two", "d")]
    assert rows_of(link, *columns) == expected
    writers.write_csv(link.select(*columns), str(tmp_path / "link"))
    assert rows_of(readers.read_kc_link(spark, str(tmp_path / "link"))) == expected
    assert (tmp_path / "link").glob("*.csv").__next__().read_text().startswith("question_id,kc_id")


def test_duplicate_topic_is_an_error(spark):
    relation = spark.createDataFrame([(1, 5, 1)], "id long, question_id long, knowledgecomponent_id long")
    kcs = spark.createDataFrame([(1, "a", "b"), (1, "c", "d")], "id long, name string, description string")
    with pytest.raises(Exception, match="duplicate topic"):
        lookups.kc_link(relation, kcs).collect()


def test_sequence_file(spark, tmp_path):
    path = tmp_path / "train.json"
    path.write_text(
        '[{"student_id": 1, "question_ids": [3, 4], "answers": [1, NaN], '
        '"difficulties": [2, 3], "hint_used": [0, 1.0]},\n'
        '{"student_id": 2, "question_ids": [5], "answers": [0], '
        '"difficulties": [1], "hint_used": [0]}]'
    )
    assert rows_of(readers.read_sequence_file(spark, str(path))) == [
        (1, 2, 0, [3, 4], [1, None], [2, 3], [0, 1]),
        (2, 1, 1, [5], [0], [1], [0]),
    ]


def test_sequence_folder(spark, tmp_path):
    record = '[{"student_id": %d, "question_ids": [], "answers": [], "difficulties": [], "hint_used": []}]'
    (tmp_path / "train_fold_2_n_10.json").write_text(record % 1)
    (tmp_path / "test_n_10.json").write_text(record % 2)
    folder = str(tmp_path)
    assert readers.read_sequence_folder(spark, folder, 10, "train", 2).first()["student_id"] == 1
    assert readers.read_sequence_folder(spark, folder, 10, "test").first()["student_id"] == 2


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_sequences_round_trip(spark, tmp_path, labelled, fmt):
    path = str(tmp_path / "out")
    writers.write_sequences(labelled, path, fmt=fmt)
    assert (tmp_path / "out" / "n=5" / "split=test" / "fold=0").is_dir()
    assert len(list((tmp_path / "out").glob("n=*/split=*/fold=*"))) == 14
    lists = ["student_id", "chunk", "question_ids", "answers", "difficulties", "hint_used"]
    for split, where in (
        ("train", splits.in_training(2)), ("val", splits.in_validation(2)), ("test", splits.in_test())
    ):
        found = readers.read_sequences(spark, path, 5, split, 2, fmt)
        assert rows_of(found, *lists) == rows_of(labelled.where("n = 5").where(where), *lists)
    plan = readers.read_sequences(spark, path, 5, "val", 2, fmt)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "n#" in plan.split("PartitionFilters: [")[1][:200]


def test_metrics_files(spark, tmp_path):
    rows = [
        ("a", 5, 1, e, s, 0.5, b, 0.5, 0.5, 3, 4, b, 0)
        for s in ("val", "test") for e, b in enumerate((0.4, 0.9, 0.6))
    ]
    writers.write_metrics(spark.createDataFrame(rows, RUN_LOG), str(tmp_path / "m"))
    best = spark.read.json(str(tmp_path / "m" / "best"))
    assert rows_of(best, "split", "epoch", "bal_acc") == [("test", 1, 0.9), ("val", 1, 0.9)]
    assert spark.read.json(str(tmp_path / "m" / "all")).count() == 6


def test_training_text_file(spark, tmp_path, labelled):
    writers.write_training_text(labelled.where("n = 5").drop("block"), str(tmp_path / "t"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "t").glob("part-*")))
    records = text.split("\n<|endoftext|>\n")
    assert records[-1] == "" and len(records) - 1 == labelled.where("n = 5").count()
    assert all(r.count(" ||| ") == 4 for r in records[:-1])


def test_json_records(spark):
    df = spark.createDataFrame([(1, [1, 2])], "a int, b array<int>")
    assert json.loads(writers.json_records(df).first()["record"]) == {"a": 1, "b": [1, 2]}


def test_counts(spark, labelled):
    log = spark.createDataFrame([(1,), (1,), (2,), (None,)], "student_id long")
    assert stats.count_students(log).first()[0] == 2
    assert rows_of(stats.questions_per_student(log)) == [(1, 2), (2, 1)]
    parts = labelled.where("n = 5").withColumn("split", splits.split_name(1))
    sizes = dict(rows_of(stats.split_sizes(parts)))
    assert sizes.pop("all") == sum(sizes.values()) == parts.count()
    ratio = stats.correct_ratio(parts).first()
    assert ratio["correct"] == parts.where(F.element_at("answers", -1) == 1).count()
    assert stats.correct_ratio(parts.where("false")).first()["correct_ratio"] is None
    assert stats.union_all(parts, parts).count() == 2 * parts.count()
    assert stats.preview(parts).count() == 5
