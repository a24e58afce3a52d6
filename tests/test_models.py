from threading import Barrier

import pytest
from pyspark.sql import functions as F

from traceflow.operators import linear, metrics, models, modeltables, selection, splits


@pytest.fixture(scope="module")
def labelled(spark):
    """The last answer equals the one before it, so it can be learned."""
    rows = spark.range(4000).select(
        (F.col("id") % 200).alias("student_id"),
        F.lit(5).alias("n"),
        F.floor(F.col("id") / 200).alias("chunk"),
        F.array(*[F.lit(1).cast("long")] * 5).alias("question_ids"),
        F.array(
            *[(F.xxhash64("id", F.lit(i)) % 2 == 0).cast("int") for i in (1, 2, 3, 4, 4)]
        ).alias("answers"),
        F.array(*[(F.pmod(F.xxhash64("id", F.lit(9 + i)), F.lit(3)) + 1).cast("int") for i in range(5)]).alias(
            "difficulties"
        ),
        F.array(*[F.lit(0)] * 5).alias("hint_used"),
    )
    split = splits.student_split(rows)
    return rows.join(split.select("student_id", "block"), "student_id").cache()


@pytest.mark.parametrize("family", models.FAMILIES)
def test_families_learn_a_simple_rule(labelled, family):
    scored = models.fit_and_predict(labelled, 5, family, iterations=30)
    row = scored.agg(F.avg((F.col("pred") == F.col("label")).cast("int")), F.count("*")).first()
    assert row[0] > 0.95
    assert row[1] == labelled.where(splits.in_test()).count()
    assert scored.where("(conf >= 0.5) != (pred = 1)").count() == 0


def test_unknown_family(labelled):
    with pytest.raises(ValueError):
        models.fit(labelled, "other")


def test_grid_log(labelled):
    cells = models.grid((5,), (1, 2), ("linear", "layers"))
    log = models.run_grid(labelled, cells, epochs=2, iterations=5, balance=True).cache()
    assert log.count() == 4 * 2 * 2
    held = labelled.where(splits.in_validation(1)).count()
    assert log.where("split = 'val'").where(F.col("sup_0") + F.col("sup_1") != held).count() == 0
    best = selection.best_config(log)
    assert {r["model"] for r in best.collect()} == {"linear", "layers"}


def test_grid_is_the_full_product():
    cells = models.grid()
    assert len(cells) == len(set(cells)) == 27
    assert cells[0] == models.Cell("linear", 5, 1) and cells[-1] == models.Cell("layers", 20, 5)


def test_a_grid_fits_lengths_together_with_few_tasks(spark, labelled, monkeypatch):
    """A fit is hundreds of jobs: none has more tasks than its rows need, and no length waits for another."""
    both = labelled.unionByName(labelled.withColumn("n", F.lit(4))).repartition(8)
    met, parts, fit = Barrier(2, timeout=60), [], models.fit

    def meeting(train, *rest, **options):
        parts.append(train.rdd.getNumPartitions())
        met.wait()
        return fit(train, *rest, **options)

    monkeypatch.setattr(models, "fit", meeting)
    log = models.run_grid(both, models.grid((4, 5), (1,), ("trees",)), iterations=2)
    assert log.count() == 4 and parts == [1, 1]


def test_more_rows_make_more_tasks(labelled, monkeypatch):
    parts, fit = [], models.fit
    monkeypatch.setattr(models, "TASK_ROWS", 1000)
    monkeypatch.setattr(models, "fit", lambda train, *a, **b: parts.append(train.rdd.getNumPartitions()) or fit(train, *a, **b))
    models.run_grid(labelled.repartition(8), models.grid((5,), (1,), ("trees",)), iterations=1)
    train = labelled.where(splits.in_training(1)).count()
    assert parts == [-(-train // 1000)] and parts[0] > 1


def test_perceptrons_keep_their_partitions(labelled, monkeypatch):
    """The rows of a partition's last block count more, so other partitions would give another model."""
    parts, fit = [], models.fit
    monkeypatch.setattr(models, "fit", lambda train, *a, **b: parts.append(train.rdd.getNumPartitions()) or fit(train, *a, **b))
    models.run_grid(labelled.repartition(8), models.grid((5,), (1,), ("layers",)), iterations=1)
    assert parts == [8]


def test_held_rows_are_scored_once(spark, labelled):
    """One plan with one aggregate, and the loss as it is alone."""
    rows = models.model_inputs(labelled, 5).withColumn("split", splits.split_name(1)).where("split <> 'train'")
    rows = rows.select("n", "split", "label", "vector").cache()
    table = modeltables.from_linear(linear.fit(rows, 5, (1, 2), steps=3)).cache()
    found = modeltables.epoch_metrics(table, rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1
    by = [*modeltables.MODEL_KEY, "split"]
    scored = modeltables.score(table, rows)
    want = metrics.binary_metrics(scored, by=by).join(metrics.mean_loss(scored, by=by), by).select(*by, "acc", "sup_1", "log_loss")
    got = {r[:5]: r[5:] for r in map(tuple, found.select(*by, "acc", "sup_1", "loss").collect())}
    assert len(got) == 4
    for r in map(tuple, want.collect()):
        assert got[r[:5]] == pytest.approx(r[5:])
