"""Classification metrics computed from one aggregate over the predictions."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceflow.functions.parsing import CORRECT, WRONG, word_flag

# Keeps the logarithm of a score of 0 or 1 finite.
LOG_EPSILON = 1e-15


def pair_predictions(labels: DataFrame, predictions: DataFrame, key: str | list[str]) -> DataFrame:
    """All labels, with the predictions of the same key; see ``unpaired``."""
    return labels.join(predictions, key, "left")


def unpaired(
    rows: DataFrame, label: str = "label", pred: str = "pred", by: Sequence[str] = ()
) -> DataFrame:
    """``n_unpaired`` and ``n_unlabelled`` per group: rows that no metric counts."""
    return rows.groupBy(*by).agg(
        F.count_if(F.col(label).isNotNull() & F.col(pred).isNull()).alias("n_unpaired"),
        F.count_if(F.col(label).isNull()).alias("n_unlabelled"),
    )


def confusion(
    rows: DataFrame, label: str = "label", pred: str = "pred", by: Sequence[str] = (), also: Mapping[str, Column] = {}
) -> DataFrame:
    """Counts ``tp, tn, fp, fn`` per group; only 0/1 labels and predictions count. ``also`` are further aggregates."""
    y, p = F.col(label), F.col(pred)
    return rows.groupBy(*by).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        *[value.alias(name) for name, value in also.items()],
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def binary_metrics(
    rows: DataFrame, label: str = "label", pred: str = "pred", by: Sequence[str] = (), also: Mapping[str, Column] = {}
) -> DataFrame:
    """``acc, bal_acc, f1_0, f1_1, sup_0, sup_1, auc`` per group, and ``also`` from the same pass.

    Balanced accuracy averages over the classes that occur among the labels.
    ``auc`` is the area for the hard predictions and NULL for a single class.
    """
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    recall_1, recall_0 = _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    return confusion(rows, label, pred, by, also).select(
        *by,
        _ratio(tp + tn, tp + tn + fp + fn).alias("acc"),
        F.coalesce((recall_0 + recall_1) / 2, recall_0, recall_1).alias("bal_acc"),
        F.coalesce(_ratio(2 * tn, 2 * tn + fp + fn), F.lit(0.0)).alias("f1_0"),
        F.coalesce(_ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1_1"),
        (tn + fp).alias("sup_0"),
        (tp + fn).alias("sup_1"),
        ((recall_0 + recall_1) / 2).alias("auc"),
        *also,
    )


def auc(
    rows: DataFrame, label: str = "label", score: str = "conf", by: Sequence[str] = ()
) -> DataFrame:
    """Area under the ROC curve of a score, ties counted half; NULL for one class.

    Rows are first reduced to counts per distinct score. Those are range
    partitioned by score; each partition sums up its own pairs, and the few
    partition totals supply the pairs across partitions. Everything is derived
    from a single exchange, so its sampled cut points cannot disagree.
    """
    counts = (
        rows.where(F.col(label).isin(0, 1) & F.col(score).isNotNull())
        .groupBy(*by, F.col(score).alias("_score"))
        .agg(
            F.count_if(F.col(label) == 0).alias("_zeros"),
            F.count_if(F.col(label) == 1).alias("_ones"),
        )
    )
    ranged = counts.repartitionByRange(*by, "_score").withColumn("_part", F.spark_partition_id())
    below = (
        Window.partitionBy(*by, "_part")
        .orderBy("_score")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.coalesce(F.sum("_zeros").over(below), F.lit(0)).cast("double")
    parts = (
        ranged.withColumn("_pairs", F.col("_ones") * (before + F.col("_zeros") / 2))
        .groupBy(*by, "_part")
        .agg(
            F.sum("_zeros").cast("double").alias("_zeros"),
            F.sum("_ones").cast("double").alias("_ones"),
            F.sum("_pairs").alias("_pairs"),
        )
    )
    earlier = (
        Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    zeros_before = F.coalesce(F.sum("_zeros").over(earlier), F.lit(0.0))
    return (
        parts.withColumn("_pairs", F.col("_pairs") + F.col("_ones") * zeros_before)
        .groupBy(*by)
        .agg(
            F.try_divide(F.sum("_pairs"), F.sum("_zeros") * F.sum("_ones")).alias("auc_score")
        )
    )


def exact_match(rows: DataFrame, truth: str = "gt", pred: str = "pred") -> DataFrame:
    """Answers equal to the truth as raw text: ``correct, total, percentage``."""
    right = F.count_if(F.col(pred).eqNullSafe(F.col(truth)))
    total = F.count(F.lit(1))
    return rows.agg(
        right.alias("correct"),
        total.alias("total"),
        (F.try_divide(right.cast("double"), total.cast("double")) * 100).alias("percentage"),
    )


def word_metrics(rows: DataFrame, truth: str = "gt", pred: str = "pred") -> DataFrame:
    """Metrics of word answers; every word but CORRECT counts as wrong.

    ``n_malformed`` tells how many answers are neither of the two words.
    """
    malformed = ~F.coalesce(F.col(pred).isin(CORRECT, WRONG), F.lit(False))
    flags = rows.select(
        word_flag(truth).alias("label"), word_flag(pred).alias("pred"), malformed.alias("_odd")
    )
    counts = flags.groupBy("label", "pred").agg(
        F.count(F.lit(1)).alias("_rows"), F.count_if("_odd").alias("_odd")
    )
    weight = F.col("_rows")
    y, p = F.col("label"), F.col("pred")

    def cell(label: int, pred_value: int, name: str) -> Column:
        return F.coalesce(
            F.sum(F.when((y == label) & (p == pred_value), weight)), F.lit(0)
        ).alias(name)

    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    recall_1, recall_0 = _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    return counts.agg(
        cell(1, 1, "tp"), cell(0, 0, "tn"), cell(0, 1, "fp"), cell(1, 0, "fn"),
        F.coalesce(F.sum("_odd"), F.lit(0)).alias("n_malformed"),
    ).select(
        F.coalesce(_ratio(2 * tn, 2 * tn + fp + fn), F.lit(0.0)).alias("f1_0"),
        F.coalesce(_ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1_1"),
        (tn + fp).alias("supp_0"),
        (tp + fn).alias("supp_1"),
        _ratio(tp + tn, tp + tn + fp + fn).alias("acc"),
        F.coalesce((recall_0 + recall_1) / 2, recall_0, recall_1).alias("bal_acc"),
        "n_malformed",
    )


def log_loss(label: str = "label", conf: str = "conf") -> Column:
    """The mean log loss of scores, an aggregate."""
    y, p = F.col(label).cast("double"), F.col(conf)
    safe = F.least(F.greatest(p, F.lit(LOG_EPSILON)), F.lit(1 - LOG_EPSILON))
    return F.avg(-(y * F.log(safe) + (1 - y) * F.log(1 - safe)))


def mean_loss(
    rows: DataFrame,
    label: str = "label",
    conf: str = "conf",
    by: Sequence[str] = (),
) -> DataFrame:
    """``log_loss`` of the scores and ``logit_loss``, which reads them as logits."""
    y, p = F.col(label).cast("double"), F.col(conf)
    return rows.groupBy(*by).agg(
        log_loss(label, conf).alias("log_loss"),
        F.avg(F.log1p(F.exp(p)) - y * p).alias("logit_loss"),
    )
