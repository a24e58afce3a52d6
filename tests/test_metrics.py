import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from traceflow.functions.parsing import threshold, verdict
from traceflow.operators import metrics, selection
from traceflow.schemas import RUN_LOG


def pairs(spark, tp=0, tn=0, fp=0, fn=0):
    rows = [(1, 1)] * tp + [(0, 0)] * tn + [(0, 1)] * fp + [(1, 0)] * fn
    return spark.createDataFrame(rows, "label int, pred int")


def test_metrics_by_hand(spark):
    row = metrics.binary_metrics(pairs(spark, 3, 1, 1, 1)).first()
    assert row["acc"] == pytest.approx(4 / 6)
    assert row["bal_acc"] == 0.625 and row["auc"] == 0.625
    assert (row["f1_1"], row["f1_0"]) == (0.75, 0.5)
    assert (row["sup_0"], row["sup_1"]) == (2, 4)


def test_one_class(spark):
    row = metrics.binary_metrics(pairs(spark, tp=3, fn=1)).first()
    assert (row["bal_acc"], row["auc"], row["f1_0"]) == (0.75, None, 0.0)
    assert metrics.auc(pairs(spark, tp=3, fn=1), score="pred").first()[0] is None


def test_no_rows(spark):
    row = metrics.binary_metrics(pairs(spark)).first()
    assert row["acc"] is None and row["bal_acc"] is None
    empty = spark.createDataFrame([], "gt string, pred string")
    assert metrics.exact_match(empty).first()["percentage"] is None
    assert metrics.word_metrics(empty).first()["acc"] is None


def test_auc_of_hard_predictions_is_balanced_accuracy(spark):
    rows = pairs(spark, 13, 7, 5, 2)
    hard = metrics.auc(rows, score="pred").first()["auc_score"]
    assert hard == pytest.approx(metrics.binary_metrics(rows).first()["bal_acc"])


def brute_auc(rows):
    ones = [s for y, s in rows if y == 1]
    zeros = [s for y, s in rows if y == 0]
    wins = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros)
    return wins / (len(ones) * len(zeros))


@pytest.mark.parametrize("partitions", ["1", "8", "50"])
def test_auc_against_all_pairs(spark, partitions):
    rng = random.Random(1)
    data = {
        g: [(rng.randint(0, 1), rng.randint(0, 40) / 40) for _ in range(300)] for g in ("a", "b")
    }
    rows = spark.createDataFrame(
        [(g, y, s) for g, part in data.items() for y, s in part], "g string, label int, conf double"
    )
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r["g"]: r["auc_score"] for r in metrics.auc(rows, by=["g"]).collect()}
        whole = metrics.auc(rows).first()["auc_score"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert found == {g: pytest.approx(brute_auc(part)) for g, part in data.items()}
    assert whole == pytest.approx(brute_auc(data["a"] + data["b"]))


def test_malformed_words(spark):
    rows = spark.createDataFrame(
        [("WRONG", "Correct."), ("CORRECT", "CORRECT"), ("CORRECT", None)], "gt string, pred string"
    )
    words = metrics.word_metrics(rows).first()
    assert words["acc"] == pytest.approx(2 / 3) and words["n_malformed"] == 2
    exact = metrics.exact_match(rows).first()
    assert (exact["correct"], exact["total"]) == (1, 3)
    assert exact["percentage"] == pytest.approx(100 / 3)


def test_verdicts(spark):
    rows = [(1, 0, 0.05), (0, 1, 0.95), (0, 0, 0.05), (1, 1, 0.9)]
    df = spark.createDataFrame(rows, "y int, p int, c double")
    found = [r[0] for r in df.select(verdict("y", "p", "c")).collect()]
    assert found == ["Balanced", "Overconfident", "Underconfident", "Balanced"]
    assert [r[0] for r in df.select(threshold("c")).collect()] == [0.0, 1.0, 0.0, 1.0]


def test_losses(spark):
    df = spark.createDataFrame([(1, 0.8), (0, 0.4)], "label int, conf double")
    row = metrics.mean_loss(df).first()
    assert row["log_loss"] == pytest.approx((0.2231435513 + 0.5108256238) / 2)
    assert row["logit_loss"] == pytest.approx((1.1711006659 - 0.8 + 0.9130152524) / 2)


def test_pairing_by_key(spark):
    labels = spark.createDataFrame([(1, 0), (2, 1)], "k long, label int")
    preds = spark.createDataFrame([(2, 1), (1, 1)], "k long, pred int")
    assert rows_of(metrics.pair_predictions(labels, preds, "k")) == [(1, 0, 1), (2, 1, 1)]


def log_row(model, n, layers, epoch, split, bal, order):
    return (model, n, layers, epoch, split, 0.5, bal, 0.5, 0.5, 1, 1, bal, order)


def test_best_run(spark):
    rows = [log_row("a", 5, 1, e, "val", b, 0) for e, b in enumerate((0.6, 0.7, 0.7))]
    rows += [log_row("b", 5, 1, e, "val", 0.0, 1) for e in range(2)]
    found = selection.best_run(spark.createDataFrame(rows, RUN_LOG), ["model", "split"])
    assert rows_of(found, "model", "epoch") == [("a", 1)]


def test_best_config(spark):
    rows = [
        log_row("a", 5, 1, 0, "val", 0.7, 0),
        log_row("a", 5, 1, 0, "test", 0.5, 0),
        log_row("a", 5, 1, 1, "val", 0.6, 0),
        log_row("a", 5, 1, 1, "test", 0.8, 0),
        log_row("a", 10, 1, 0, "val", 0.7, 1),
        log_row("a", 10, 1, 0, "test", 0.9, 1),
    ]
    log = spark.createDataFrame(rows, RUN_LOG)
    row = selection.best_config(log).first()
    assert (row["n"], row["val"]["epoch"], row["test"]["bal_acc"]) == (5, 0, 0.8)
    row = selection.best_config(log, test_at="val").first()
    assert (row["n"], row["val"]["epoch"], row["test"]["bal_acc"]) == (5, 0, 0.5)
    assert log.where(F.col("bal_acc") > 0).count() == 6
