"""A linear family fitted by full-batch gradient steps, with its models as rows of a table.

Every step is one aggregate over the training data and serves all configurations at
once. Equal inputs are counted first, so a step reads distinct ones. Tasks hand on
one short row each; these are added exactly, so their order changes nothing and
a fit gives the same numbers when it is run again. Weights go on from epoch to
epoch, and every epoch's weights are a row, so all epochs are scored in one pass.
"""

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceflow.functions.parsing import threshold
from traceflow.operators.metrics import binary_metrics, mean_loss
from traceflow.session import checkpoint

NAME = "linear"
# Decay of the two running means of Adam, and its guard against division by zero.
DECAYS, GUARD = (0.9, 0.999), 1e-8
RATE = 0.1
# L2 penalty of one layer; more layers mean less of it.
PENALTY = 0.01
_EXACT = "decimal(38,20)"
# Distinct inputs of a task, and how many tasks' sums, one short row each, the driver adds itself.
TASK_ROWS, DRIVER_PARTS = 200_000, 256

MODELS = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("layers", T.IntegerType()),
        T.StructField("epoch", T.IntegerType()),
        T.StructField("bias", T.DoubleType()),
        T.StructField("weights", T.ArrayType(T.DoubleType())),
        # Mean training loss over the steps of the epoch, each before its step.
        T.StructField("train_loss", T.DoubleType()),
    ]
)


def counted(train: DataFrame) -> tuple[DataFrame, int]:
    """Distinct (x, label) of ``vector`` and ``label`` with the number of their rows, written once; and its tasks."""
    x = vector_to_array("vector").alias("x")
    rows = train.select(x, F.col("label").cast("double").alias("label"))
    written = checkpoint(rows.groupBy("x", "label").agg(F.count(F.lit(1)).cast("double").alias("many")))
    tasks = max(1, -(-written.count() // TASK_ROWS))
    return written.coalesce(tasks), tasks


def _batch(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    label = batch.column(1).to_numpy(zero_copy_only=False)
    many = batch.column(2).to_numpy(zero_copy_only=False)
    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(label), -1)
    return x, label, many


def _sums(rows: tuple[DataFrame, int], partial) -> np.ndarray:
    """Sum over all batches of an array that ``partial`` makes of (x, label, many)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            if batch.num_rows:
                total = total + partial(*_batch(batch))
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["part"])

    table, tasks = rows
    parts = table.select("x", "label", "many").mapInArrow(run, "part array<double>")
    if tasks <= DRIVER_PARTS:
        return np.array([math.fsum(column) for column in zip(*[r[0] for r in parts.collect()], strict=True)])
    added = parts.select(F.posexplode("part").alias("at", "value")).groupBy("at").agg(
        F.sum(F.col("value").cast(_EXACT)).cast("double").alias("value")
    )
    found = dict(added.collect())
    return np.array([found[k] for k in range(len(found))])


def _moments(x: np.ndarray, label: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.concatenate([[many.sum()], many @ x, many @ (x * x)])


def _slopes(weights: np.ndarray, mean: np.ndarray, scale: np.ndarray):
    """Per configuration: loss, then the slopes of bias and weights, summed over rows."""

    def partial(x: np.ndarray, label: np.ndarray, many: np.ndarray) -> np.ndarray:
        inputs = np.column_stack([np.ones(len(x)), (x - mean) / scale])
        z = inputs @ weights.T
        loss = np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z))) - label[:, None] * z
        off = 1 / (1 + np.exp(-z)) - label[:, None]
        return np.column_stack([many @ loss, (many[:, None] * off).T @ inputs]).ravel()

    return partial


def fit(
    train: DataFrame,
    n: int,
    layers: Sequence[int] = (1,),
    epochs: int = 1,
    steps: int = 20,
    rate: float = RATE,
    penalty: float = PENALTY,
) -> DataFrame:
    """One row of ``MODELS`` per configuration and epoch, fitted on ``vector`` and ``label``.

    Inputs are standardised by their mean and deviation over the training rows; the weights
    returned apply to raw inputs. A step is Adam's on the mean slope of the logistic loss plus
    ``penalty / layers`` times the weight, without the bias. An epoch is ``steps`` of them. The driver holds the
    weights alone. Constant inputs get no weight; without training rows all weights are zero.
    """
    rows = counted(train)
    spark = train.sparkSession
    sums = _sums(rows, _moments)
    if not len(sums):
        return spark.createDataFrame([(NAME, n, k, e, 0.0, [], None) for k in layers for e in range(epochs)], MODELS)
    total, width = sums[0], len(sums) // 2
    mean = sums[1 : width + 1] / total
    scale = np.sqrt(np.maximum(sums[width + 1 :] / total - mean * mean, 0))
    scale[scale < GUARD] = 1.0
    shrink = np.outer([penalty / k for k in layers], np.r_[0.0, np.ones(width)])
    weights = np.zeros((len(layers), width + 1))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    found, step = [], 0
    for epoch in range(epochs):
        losses = np.zeros(len(layers))
        for _ in range(steps):
            step += 1
            sums = _sums(rows, _slopes(weights, mean, scale)).reshape(len(layers), -1) / total
            losses += sums[:, 0]
            slope = sums[:, 1:] + shrink * weights
            first = DECAYS[0] * first + (1 - DECAYS[0]) * slope
            second = DECAYS[1] * second + (1 - DECAYS[1]) * slope * slope
            root = np.sqrt(second / (1 - DECAYS[1] ** step))
            weights = weights - rate * (first / (1 - DECAYS[0] ** step)) / (root + GUARD)
        raw = weights[:, 1:] / scale
        bias = weights[:, 0] - raw @ mean
        for k, depth in enumerate(layers):
            found.append((NAME, n, depth, epoch, float(bias[k]), raw[k].tolist(), float(losses[k] / max(1, steps))))
    return spark.createDataFrame(found, MODELS)


def confidence(x: Column, weights: Column, bias: Column) -> Column:
    """Probability of label 1."""
    products = F.zip_with(x, weights, lambda a, b: a * b)
    z = bias + F.aggregate(products, F.lit(0.0), lambda s, p: s + F.coalesce(p, F.lit(0.0)))
    return 1 / (1 + F.exp(-z))


def score(models: DataFrame, inputs: DataFrame) -> DataFrame:
    """``inputs`` (n, vector, label and others) once per model of their length, with conf and pred.

    Models are few and short: configurations times epochs. They are broadcast, so the inputs are read once and never moved.
    """
    used = models.select("model", F.col("n").alias("_n"), "layers", "epoch", "weights", "bias")
    kept = [F.col(c) for c in inputs.columns if c not in ("conf", "pred", "vector", "model", "layers", "epoch")]
    rows = inputs.withColumn("_x", vector_to_array("vector"))
    scored = rows.join(F.broadcast(used), F.col("n") == F.col("_n")).select(
        *kept, "model", "layers", "epoch", confidence(F.col("_x"), F.col("weights"), F.col("bias")).alias("conf")
    )
    return scored.withColumn("pred", threshold("conf").cast("int"))


def epoch_metrics(models: DataFrame, held: DataFrame) -> DataFrame:
    """Metrics and mean loss of every model, epoch and split of ``held``, from one pass over it."""
    by = ["model", "n", "layers", "epoch", "split"]
    scored = score(models, held).select(*by, "label", "pred", "conf")
    loss = mean_loss(scored, by=by).select(*by, F.col("log_loss").alias("loss"))
    return binary_metrics(scored, by=by).join(loss, by)
