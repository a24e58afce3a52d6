"""Parallel readers against Spark's own readers, which take one task per file."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceflow.schemas import KCS, SEQUENCE_FILE
from traceflow.sources import ranges, readers

BYTES = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def cut(spark):
    """Reads files in ranges of at most so many bytes."""

    def set_bytes(many):
        spark.conf.set(BYTES, str(many))
        spark.conf.set("spark.sql.files.openCostInBytes", str(min(many, 4 << 20)))

    yield set_bytes
    spark.conf.unset(BYTES)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def field(rng):
    kind = rng.random()
    if kind < 0.4:
        return rng.choice(["plain", "7", "", "with space", "ümlaut"])
    inner = "".join(rng.choice(['""', "\n", "\r\n", ",", "word", " ", "x" * 30, "\n\n"]) for _ in range(rng.randint(0, 8)))
    return f'"{inner}"'


def csv_text(rng, rows, end):
    lines = ["id,name,description"] + [f"{i},{field(rng)},{field(rng)}" for i in range(rows)]
    return end.join(lines) + (end if rng.random() < 0.5 else "")


def as_rows(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("many", [700, 1 << 27])
def test_quoted_csv(spark, cut, tmp_path, end, many):
    rng = random.Random(many)
    for k in range(3):
        (tmp_path / f"f{k}.csv").write_text(csv_text(rng, 60, end), newline="")
    path = str(tmp_path)
    want = as_rows(spark.read.csv(path, header=True, multiLine=True, escape='"'))
    cut(many)
    read = ranges.read_quoted_csv(spark, path)
    assert read.columns == ["id", "name", "description"]
    assert as_rows(read) == want and len(want) == 180
    used = ranges.read_records(spark, path, "csv")
    assert used.groupBy("file").agg(F.max("place"), F.count("*")).select("max(place)", "count(1)").distinct().collect() == [(60, 61)]


def test_many_tasks_read_one_csv(spark, cut, tmp_path):
    (tmp_path / "f.csv").write_text(csv_text(random.Random(1), 2000, "\n"), newline="")
    cut(4000)
    rows = spark.read.option("lineSep", "\n").text(str(tmp_path / "f.csv"))
    assert rows.select(F.col("_metadata.file_block_start")).distinct().count() > 15
    placed = ranges.read_quoted_csv(spark, str(tmp_path / "f.csv"), position="at")
    got = placed.orderBy("at").select("id").collect()
    assert [r[0] for r in got] == [str(i) for i in range(2000)]


def test_one_field_over_many_ranges(spark, cut, tmp_path):
    """Whole ranges inside one field, an open quote at the end, a file that is only a header, blank lines, odd names."""
    long = "line\n" * 400
    (tmp_path / "a.csv").write_text(f'id,,"na\nme"\n1,"{long}",x\n\n2,"a ""b""",y\n')
    (tmp_path / "b.csv").write_text('id,,"na\nme"')
    cut(300)
    read = ranges.read_quoted_csv(spark, str(tmp_path))
    assert read.columns == ["id", "_c1", "na\nme"]
    assert as_rows(read) == [("1", long, "x"), ("2", 'a "b"', "y")]
    (tmp_path / "b.csv").write_text('id,n\n1,"open\nand on')
    assert ranges.read_records(spark, str(tmp_path / "b.csv"), "csv").count() == 2
    (tmp_path / "c.csv").write_text("")
    assert ranges.read_quoted_csv(spark, str(tmp_path / "c.csv")).count() == 0


def record(rng, i):
    many = rng.randint(0, 5)
    return {
        "student_id": i,
        "question_ids": [rng.randrange(99) for _ in range(many)],
        "answers": [rng.choice([0, 1, float("nan")]) for _ in range(many)],
        "difficulties": [1.0] * many,
        "hint_used": [0] * many,
        "note": rng.choice(["plain", 'br}{ace "q" \\', "}{", "\\\\", "é}\n"]),
        "deep": {"a": {"b": "}"}, "c": [{"d": 1}] * rng.randint(0, 2)},
    }


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("many", [900, 1 << 27])
def test_json_array(spark, cut, tmp_path, indent, many):
    rng = random.Random(7)
    rows = [record(rng, i) for i in range(80)]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=indent))
    (tmp_path / "b.json").write_text("[]")
    schema = T.StructType([*SEQUENCE_FILE.fields, T.StructField("note", T.StringType())])
    want = spark.read.schema(schema).json(str(tmp_path / "a.json"), multiLine=True).collect()
    cut(many)
    got = ranges.read_json_array(spark, str(tmp_path), schema).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(80))
    assert [str(tuple(r)[:-1]) for r in got] == [str(tuple(r)) for r in want]


@pytest.mark.parametrize("many", [400, 1 << 27])
def test_sequence_file_has_a_stable_chunk(spark, cut, tmp_path, many):
    rng = random.Random(3)
    rows = [{k: v for k, v in record(rng, i).items() if k not in ("note", "deep")} for i in range(40)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    cut(many)
    read = readers.read_sequence_file(spark, str(tmp_path / "a.json")).orderBy("chunk").collect()
    assert [(r["student_id"], r["chunk"], r["n"]) for r in read] == [(i, i, len(r["answers"])) for i, r in enumerate(rows)]


def test_topics_in_ranges(spark, cut, tmp_path):
    (tmp_path / "k.csv").write_text('id,name,description\n1,One,"a\nb, ""c"""\n2,Two,\n')
    cut(8)
    assert as_rows(readers.read_kcs(spark, str(tmp_path / "k.csv"))) == [(1, "One", 'a\nb, "c"'), (2, "Two", None)]
    assert [f.dataType for f in readers.read_kcs(spark, str(tmp_path / "k.csv")).schema] == [f.dataType for f in KCS]
