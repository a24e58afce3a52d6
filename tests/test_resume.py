"""Jobs that are stopped half way and go on."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from traceflow.operators import linear, models, scoring
from traceflow.operators.runlog import RunLog
from traceflow.operators.splits import student_split
from traceflow.schemas import GRID_LOG


@pytest.fixture(scope="module")
def labelled(spark):
    rows = spark.range(800).select(
        (F.col("id") % 80).alias("student_id"),
        F.lit(5).alias("n"),
        F.floor(F.col("id") / 80).alias("chunk"),
        F.array(*[F.lit(1).cast("long")] * 5).alias("question_ids"),
        F.array(*[(F.xxhash64("id", F.lit(i)) % 2 == 0).cast("int") for i in (1, 2, 3, 4, 4)]).alias("answers"),
        F.array(*[(F.pmod(F.xxhash64("id", F.lit(9 + i)), F.lit(3)) + 1).cast("int") for i in range(5)]).alias("difficulties"),
        F.array(*[F.lit(0)] * 5).alias("hint_used"),
    )
    return rows.join(student_split(rows).select("student_id", "block"), "student_id").cache()


def test_a_grid_goes_on_where_it_stopped(spark, labelled, tmp_path, monkeypatch):
    cells = models.grid((5,), (1, 2), ("linear", "trees"))
    options = {"iterations": 3, "parallelism": 1}
    whole = models.run_grid(labelled, cells, **options)
    log = RunLog(spark, str(tmp_path / "log"), GRID_LOG, models.CELL_KEY)
    fitted, fit = [], models.fit

    def stopping(train, family, layers, **rest):
        if layers == 2 and not fitted.count("stopped"):
            fitted.append("stopped")
            raise RuntimeError("stopped")
        fitted.append((family, layers))
        return fit(train, family, layers, **rest)

    monkeypatch.setattr(models, "fit", stopping)
    with pytest.raises(RuntimeError):
        models.run_grid(labelled, cells, log=log, **options)
    assert log.finished() == {("linear", 5, 1), ("linear", 5, 2), ("trees", 5, 1)}
    monkeypatch.setattr(linear, "fit", None)
    resumed = models.run_grid(labelled, cells, log=log, **options)
    assert fitted == [("trees", 1), "stopped", ("trees", 2)]
    assert rows_of(resumed) == rows_of(whole)
    # Nothing is left to do, and fewer cells may be asked for.
    assert rows_of(models.run_grid(labelled, cells[:1], log=log, **options)) == rows_of(whole.where("layers = 1 and model = 'linear'"))
    assert len(fitted) == 3


def test_a_log_reads_each_run_once(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "log"), GRID_LOG, models.CELL_KEY)
    assert log.finished() == set() and log.read().count() == 0
    row = ("a", 5, 1, 0, "val", 0.5, 0.5, 0.5, 0.5, 3, 4, None, 0, 0.7)
    log.add([row])
    log.add([row])
    assert rows_of(log.read()) == [row]
    assert log.read([("a", 5, 2)]).count() == 0 and log.read([("a", 5, 1)]).count() == 1


def prompts_of(spark, many, copies=1):
    chat = F.array(
        F.struct(F.lit("assistant").alias("role"), F.lit("Predict").alias("content")),
        F.struct(F.lit("user").alias("role"), F.concat(F.lit("q"), F.col("id") % many).alias("content")),
    )
    return spark.range(many * copies).select("id", chat.alias("prompt"), F.lit(1).alias("key"))


class Counting:
    """Notes every prompt it is asked in a file of its own; fails for some until told otherwise."""

    def __init__(self, folder, broken=(), kind=TimeoutError):
        self.folder, self.broken, self.kind = folder, set(broken), kind

    def __call__(self, chats):
        names = [chat[-1][1] for chat in chats]
        if self.broken & set(names) and not (Path(self.folder) / "mended").exists():
            raise self.kind("down")
        with (Path(self.folder) / "asked").open("a") as out:
            out.write("".join(f"{n}\n" for n in names))
        assert len(chats) <= 4
        return [f"answer to {n}" for n in names]

    def asked(self):
        path = Path(self.folder) / "asked"
        return sorted(path.read_text().split()) if path.exists() else []


def test_each_prompt_is_asked_once(spark, tmp_path):
    """Copies of a prompt, a second call, and a job that is stopped half way."""
    scorer = Counting(tmp_path, {"q7"}, KeyError)
    rows = prompts_of(spark, 40, copies=3)
    options = {"path": str(tmp_path / "answers"), "batch": 4, "in_flight": 2, "wave": 10}
    with pytest.raises(Exception, match="down"):
        scoring.score_stored(rows, scorer, **options)
    before = scorer.asked()
    assert len(before) < 40
    (tmp_path / "mended").write_text("")
    found = scoring.score_stored(rows, scorer, **options)
    assert rows_of(found, "id", "pred") == [(i, f"answer to q{i % 40}") for i in range(120)]
    stored = spark.read.parquet(options["path"]).count()
    assert stored == 40
    # Only what the stopped wave had under way may be asked again.
    assert set(scorer.asked()) == {f"q{i}" for i in range(40)} and len(scorer.asked()) <= 40 + 10
    again = len(scorer.asked())
    assert scoring.score_stored(rows, scorer, **options).count() == 120 and len(scorer.asked()) == again
    assert found.columns == ["id", "prompt", "key", "pred"]


def test_failures_are_asked_again_and_end_in_null(spark, tmp_path):
    scorer = Counting(tmp_path, {"q3"})
    rows = prompts_of(spark, 9)
    options = {"path": str(tmp_path / "answers"), "batch": 1, "in_flight": 2, "rounds": 2, "pause": 0.0, "error": "why"}
    found = scoring.score_stored(rows, scorer, **options)
    assert rows_of(found.where("pred is null"), "id", "why") == [(3, "TimeoutError('down')")]
    assert scorer.asked() == sorted(f"q{i}" for i in range(9) if i != 3)
    (tmp_path / "mended").write_text("")
    assert scoring.score_stored(rows, scorer, **options).where("pred is null or why is not null").count() == 0
    assert len(scorer.asked()) == 9


def test_no_prompts(spark, tmp_path):
    found = scoring.score_stored(prompts_of(spark, 3).limit(0), Counting(tmp_path), path=str(tmp_path / "a"))
    assert found.count() == 0 and found.columns[-1] == "pred"
