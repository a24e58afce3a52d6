"""Fit, apply and compare sequence classifiers with Spark ML."""

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import groupby
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import (
    GBTClassifier,
    MultilayerPerceptronClassifier,
    NaiveBayes,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceflow.functions.features import model_inputs
from traceflow.functions.parsing import threshold
from traceflow.operators import linear, modeltables
from traceflow.operators.runlog import RunLog
from traceflow.operators.sampling import downsample
from traceflow.operators.selection import METRICS
from traceflow.operators.splits import split_name
from traceflow.schemas import GRID_LOG
from traceflow.session import checkpoint

FAMILIES = ("linear", "trees", "layers")
# Fitted from counts alone, so its numbers can be had from any aggregate engine.
COUNTS = "counts"
# What tells the runs of a grid apart.
CELL_KEY = ("model", "n", "layers")
# Values a step's difficulty and answer can take in the one-hot form.
DIFFICULTIES = (1, 2, 3)
ANSWERS = (0, 1)
# Training rows of one task of a grid's fits, but for perceptrons.
TASK_ROWS = 50_000


@dataclass(frozen=True)
class Cell:
    """One configuration of the grid."""

    family: str
    n: int
    layers: int


def grid(
    lengths: Sequence[int] = (5, 10, 20),
    layers: Sequence[int] = (1, 2, 5),
    families: Sequence[str] = FAMILIES,
) -> list[Cell]:
    return [Cell(family, n, depth) for n in lengths for depth in layers for family in families]


def fit(
    train: DataFrame,
    family: str,
    layers: int = 1,
    width: int = 10,
    hidden: int = 8,
    iterations: int = 20,
    seed: int = 42,
    previous: Model | None = None,
) -> Model:
    """Fit one classifier on ``vector`` and ``label``; the linear family is in ``linear.fit``.

    ``layers`` is the complexity: hidden layers of the perceptron, depth of the
    trees, and for the linear model the inverse of its regularisation. ``width``
    is the length of the vector. A perceptron goes on from ``previous``.
    """
    columns = {"featuresCol": "vector", "labelCol": "label"}
    if family == "trees":
        estimator = GBTClassifier(maxIter=iterations, maxDepth=layers, seed=seed, **columns)
    elif family == COUNTS:
        estimator = NaiveBayes(smoothing=1.0, modelType="multinomial", **columns)
    elif family == "layers":
        estimator = MultilayerPerceptronClassifier(
            layers=[width, *[hidden] * layers, 2], maxIter=iterations, seed=seed, **columns
        )
        if previous is not None:
            estimator = estimator.setInitialWeights(previous.weights)
    else:
        raise ValueError(f"unknown family {family}")
    return estimator.fit(train)


def one_hot_steps() -> Column:
    """Sequences as counts: per step but the last its difficulty and answer, then the last difficulty."""
    told = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size("answers") - 2),
            lambda i: F.array(
                *[
                    ((F.get("difficulties", i) == d) & (F.get("answers", i) == a)).cast("double")
                    for d in DIFFICULTIES
                    for a in ANSWERS
                ]
            ),
        )
    )
    asked = F.try_element_at("difficulties", F.lit(-1))
    return F.concat(told, F.array(*[(asked == d).cast("double") for d in DIFFICULTIES]))


def _split(rows: DataFrame, fold: int) -> DataFrame:
    """Rows seen from one fold with their ``split``: from ``block``, or as written with a fold."""
    if "block" in rows.columns:
        return rows.withColumn("split", split_name(fold))
    if "split" not in rows.columns:
        raise ValueError("sequences need a column block or split")
    return rows.where(F.col("fold").isin(fold, 0)) if "fold" in rows.columns else rows


def predict(model: Model, inputs: DataFrame) -> DataFrame:
    """Add ``conf``, the probability of a correct answer, and ``pred``, 0 or 1."""
    scored = model.transform(inputs)
    kept = [c for c in inputs.columns if c not in ("conf", "pred")]
    return scored.select(*kept, vector_to_array("probability")[1].alias("conf")).withColumn(
        "pred", threshold("conf").cast("int")
    )


def _fit_epochs(
    train: DataFrame, cell: Cell, width: int, epochs: int, iterations: int, seed: int
) -> DataFrame:
    """A cell's model after each epoch, as rows of ``modeltables.TABLE``."""
    spark = train.sparkSession
    model, found = None, []
    for epoch in range(epochs):
        resumes = cell.family == "layers"
        model = fit(
            train,
            cell.family,
            cell.layers,
            width=width,
            iterations=iterations if resumes else iterations * (epoch + 1),
            seed=seed,
            previous=model if resumes else None,
        )
        as_rows = modeltables.from_layers if resumes else modeltables.from_trees
        found.append(as_rows(spark, model, (cell.family, cell.n, cell.layers, epoch)))
    return reduce(DataFrame.unionByName, found)


def _log_rows(fitted: DataFrame, held: DataFrame, cells: Sequence[tuple[int, Cell]]) -> list[tuple]:
    """Metric rows of cells of one length, in the order of the grid; all their models in one scoring of ``held``."""
    places = {(cell.family, cell.layers): place for place, cell in cells}
    rows = modeltables.epoch_metrics(fitted, held.withColumn("n", F.lit(cells[0][1].n))).collect()
    rows.sort(key=lambda r: (places[r["model"], r["layers"]], r["epoch"], r["split"]))
    return [
        (*[r[c] for c in (*modeltables.MODEL_KEY, "split", *METRICS)], places[r["model"], r["layers"]], r["loss"])
        for r in rows
    ]


def run_grid(
    labelled: DataFrame,
    cells: Iterable[Cell],
    fold: int = 1,
    with_kc: bool = False,
    balance: bool = False,
    epochs: int = 1,
    iterations: int = 20,
    seed: int = 42,
    parallelism: int = 4,
    log: RunLog | None = None,
) -> DataFrame:
    """Fit every cell and log its metrics on validation and test.

    ``labelled`` holds sequences of all lengths with their block. The driver
    only submits fits, ``parallelism`` at a time whatever their lengths, and keeps their weights and two metric rows per
    fit; features are computed once per length and stay on the executors. With
    several epochs a perceptron and the linear cells go on from their last weights; trees
    are fitted with a budget of iterations that grows with the epoch. All linear cells of a
    length share the passes of their fit, and the models of all cells of a length, kept as rows, are scored
    together. With a ``log`` (by ``CELL_KEY``) a cell is scored and added to it as soon as it is fitted,
    and cells that it has are not fitted again.
    """
    spark = labelled.sparkSession
    cells = list(cells)
    per_step = 3 if with_kc else 2
    done = log.finished() if log else set()
    left = [(i, c) for i, c in enumerate(cells) if (c.family, c.n, c.layers) not in done]
    lengths = list(dict.fromkeys(c.n for _, c in left))
    # One pass makes the sequences of all lengths; it is cached until their features are.
    lists = ("answers", "difficulties", *["kc_ids"] * with_kc)
    rows = _split(labelled.where(F.col("n").isin(lengths)), fold).select("student_id", "n", "chunk", "split", *lists)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    cached = [rows]

    @inheritable_thread_target(spark)
    def prepare(n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        inputs = (
            model_inputs(rows.where(F.col("n") == n), n, with_kc)
            .select("student_id", "chunk", "split", "label", "vector")
            .persist(StorageLevel.MEMORY_AND_DISK)
        )
        cached.append(inputs)
        train = inputs.where(F.col("split") == "train")
        if balance:
            train = downsample(train, "label", ["student_id", "chunk"], seed)
        train = train.select("label", "vector").persist(StorageLevel.MEMORY_AND_DISK)
        cached.append(train)
        # A fit is hundreds of jobs, each with a task per partition.
        tasks = max(1, -(-train.count() // TASK_ROWS))
        # Spark's perceptron weighs the last, shorter block of a partition more: its partitions stay as they are.
        return train, train.coalesce(tasks), inputs.where(F.col("split") != "train")

    @inheritable_thread_target(spark)
    def run(group: list[tuple[int, Cell]]) -> tuple[DataFrame, list[tuple]]:
        family, n = group[0][1].family, group[0][1].n
        spread, few, held = data[n]
        train = spread if family == "layers" else few
        if family == linear.NAME:
            depths = [cell.layers for _, cell in group]
            fitted = modeltables.from_linear(linear.fit(train, n, depths, epochs, iterations))
        else:
            fitted = _fit_epochs(train, group[0][1], n * per_step, epochs, iterations, seed)
        if not log:
            return fitted, []
        rows = _log_rows(fitted, held, group)
        for _, of_cell in groupby(rows, key=lambda r: r[:3]):
            log.add(of_cell)
        return fitted, rows

    @inheritable_thread_target(spark)
    def scored(n: int) -> list[tuple]:
        models = [f for group, (f, _) in zip(groups, fitted, strict=True) if group[0][1].n == n]
        return _log_rows(reduce(DataFrame.unionByName, models), data[n][2], [(i, c) for i, c in left if c.n == n])

    groups = []
    for n in lengths:
        own = [(i, cell) for i, cell in left if cell.n == n]
        straight = [(i, cell) for i, cell in own if cell.family == linear.NAME]
        groups += [straight] * bool(straight) + [[one] for one in own if one[1].family != linear.NAME]
    if not log:
        # Those with the most jobs first, so that none of them is alone at the end.
        groups.sort(key=lambda group: -group[-1][1].layers)
    records = []
    try:
        with ThreadPool(max(1, min(parallelism, len(groups)))) as pool:
            if lengths:
                rows.count()
            data = dict(zip(lengths, pool.map(prepare, lengths, chunksize=1), strict=True))
            rows.unpersist()
            fitted = pool.map(run, groups, chunksize=1)
            if not log:
                records = [row for rows in pool.map(scored, lengths, chunksize=1) for row in rows]
    finally:
        for kept in cached:
            kept.unpersist()
    if log:
        return log.read((c.family, c.n, c.layers) for c in cells)
    return spark.createDataFrame(records, GRID_LOG)


def fit_and_predict(
    labelled: DataFrame,
    n: int = 5,
    family: str = "linear",
    layers: int = 1,
    fold: int = 1,
    iterations: int = 20,
    with_kc: bool = False,
    balance: bool = False,
    splits: Sequence[str] = ("test",),
    seed: int = 42,
) -> DataFrame:
    """Fit on the training students of a fold and score the sequences of ``splits``.

    The family ``counts`` reads steps in their one-hot form and needs no topics.
    """
    inputs = model_inputs(_split(labelled.where(F.col("n") == n), fold), n, with_kc)
    if family == COUNTS:
        inputs = inputs.withColumn("vector", array_to_vector(one_hot_steps()))
    inputs = inputs.select("student_id", "chunk", "split", "label", "vector")
    inputs = inputs.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        train = inputs.where(F.col("split") == "train")
        if balance:
            train = downsample(train, "label", ["student_id", "chunk"], seed)
        if family == linear.NAME:
            model = linear.fit(train, n, (layers,), steps=iterations)
        else:
            model = fit(train, family, layers, width=(3 if with_kc else 2) * n, iterations=iterations, seed=seed)
        # Kept apart from the cache, which goes when this function ends.
        held = checkpoint(inputs.where(F.col("split").isin(*splits)).drop("split"))
    finally:
        inputs.unpersist()
    if family == linear.NAME:
        return linear.score(model, held.withColumn("n", F.lit(n))).select(
            "student_id", "chunk", "label", "conf", "pred"
        )
    return predict(model, held)
