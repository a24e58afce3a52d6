"""Fitted classifiers as rows of one table, all of them scored by built-in functions in one pass.

A row is one model: a ``net`` of dense layers, or weighted ``trees`` of nodes. Both are read by higher-order
functions, so scoring starts no Python worker, loads no saved model and reads the inputs once, however many
models there are. The table can be written, read, filtered and joined like any other.
"""

import uuid

from pyspark.ml.classification import GBTClassificationModel, MultilayerPerceptronClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceflow.functions.parsing import threshold
from traceflow.operators.metrics import binary_metrics, log_loss
from traceflow.session import shared_folder

# What tells models apart.
MODEL_KEY = ("model", "n", "layers", "epoch")
# A unit of a layer is its bias followed by its weights. A leaf has ``low`` = ``high`` = -1; ``depth`` is the
# number of tests on the longest way from node 0 to a leaf.
TABLE = (
    "model string, n int, layers int, epoch int, net array<array<array<double>>>, "
    "trees array<struct<weight: double, depth: int, "
    "nodes: array<struct<feature: int, threshold: double, low: int, high: int, value: double>>>>"
)
_TREES = TABLE.partition("trees ")[2]
# What is read of the node tables that Spark saves trees as.
_SAVED = (
    "treeID int, nodeData struct<id: int, prediction: double, leftChild: int, rightChild: int, "
    "split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>>>"
)


def from_linear(fitted: DataFrame) -> DataFrame:
    """The models of ``linear.fit``: one layer of one unit each. A model without weights stays one of its bias."""
    unit = F.concat(F.array("bias"), "weights")
    return fitted.select(*MODEL_KEY, F.array(F.array(unit)).alias("net"), F.lit(None).cast(_TREES).alias("trees"))


def from_layers(spark: SparkSession, model: MultilayerPerceptronClassificationModel, key: tuple) -> DataFrame:
    """A perceptron of two classes, whose two last units become the one of their difference."""
    flat = [float(w) for w in model.weights]
    sizes, net, at = model.getLayers(), [], 0
    for inputs, outputs in zip(sizes, sizes[1:], strict=False):
        bias = at + inputs * outputs
        net.append([[flat[bias + o], *flat[at + o : bias : outputs]] for o in range(outputs)])
        at = bias + outputs
    if sizes[-1] != 2:
        raise ValueError("a model needs two classes")
    wrong, right = net[-1]
    net[-1] = [[r - w for r, w in zip(right, wrong, strict=True)]]
    return spark.createDataFrame([(*key, net, None)], TABLE)


def from_trees(spark: SparkSession, model: GBTClassificationModel, key: tuple) -> DataFrame:
    """Boosted trees, from the node tables that Spark saves them as."""
    path = f"{shared_folder(spark)}/traceflow-{uuid.uuid4().hex}"
    model.save(path)
    # The fitted model is on the driver already, and so are its few nodes.
    leaf = F.col("leftChild") < 0
    nodes = spark.read.schema(_SAVED).parquet(f"{path}/data").select("treeID", "nodeData.*").select(
        "treeID",
        "id",
        F.when(~leaf, F.col("split.featureIndex")),
        F.when(~leaf, F.get("split.leftCategoriesOrThreshold", F.lit(0))),
        "leftChild",
        "rightChild",
        "prediction",
    )
    grown = [(float(w), t.depth, []) for w, t in zip(model.treeWeights, model.trees, strict=True)]
    for tree, _, *node in sorted(nodes.collect(), key=lambda r: r[:2]):
        grown[tree][2].append(tuple(node))
    return spark.createDataFrame([(*key, None, grown)], TABLE)


def node_rows(models: DataFrame) -> DataFrame:
    """One row per node of the trees: key, tree, tree_weight, node, feature, threshold, low, high, value."""
    trees = models.select(*MODEL_KEY, F.posexplode("trees").alias("tree", "_t"))
    nodes = trees.select(*MODEL_KEY, "tree", F.col("_t.weight").alias("tree_weight"), F.posexplode("_t.nodes").alias("node", "_n"))
    return nodes.select(*MODEL_KEY, "tree", "tree_weight", "node", "_n.*")


def weight_rows(models: DataFrame) -> DataFrame:
    """One row per weight of the nets: key, layer, unit, input (0 is the bias), weight."""
    layers = models.select(*MODEL_KEY, F.posexplode("net").alias("layer", "_l"))
    units = layers.select(*MODEL_KEY, "layer", F.posexplode("_l").alias("unit", "_u"))
    return units.select(*MODEL_KEY, "layer", "unit", F.posexplode("_u").alias("input", "weight"))


def _sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def _through(net: Column, x: Column) -> Column:
    def unit(inputs: Column, u: Column) -> Column:
        products = F.zip_with(inputs, F.slice(u, 2, F.size(u)), lambda a, w: F.coalesce(a * w, F.lit(0.0)))
        return _sigmoid(F.aggregate(products, F.get(u, F.lit(0)), lambda total, p: total + p))

    return F.get(F.aggregate(net, x, lambda inputs, layer: F.transform(layer, lambda u: unit(inputs, u))), F.lit(0))


def _down(trees: Column, x: Column) -> Column:
    def leaf(tree: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            node = F.get(tree["nodes"], at)
            low = F.get(x, node["feature"]) <= node["threshold"]
            return F.when(node["low"] < 0, at).when(low, node["low"]).otherwise(node["high"])

        return F.get(tree["nodes"], F.aggregate(F.array_repeat(F.lit(0), tree["depth"]), F.lit(0), step))

    margin = F.aggregate(trees, F.lit(0.0), lambda total, tree: total + tree["weight"] * leaf(tree)["value"])
    return _sigmoid(2 * margin)


def confidence(x: Column, net: Column, trees: Column) -> Column:
    """Probability of label 1 of the inputs ``x``, an array; NULL for a NULL array. A value that is missing goes high in trees."""
    return F.when(x.isNotNull(), F.when(trees.isNotNull(), _down(trees, x)).otherwise(_through(net, x)))


def score(models: DataFrame, inputs: DataFrame) -> DataFrame:
    """``inputs`` (n, vector, label and others) once per model of their length, with conf and pred.

    Models are fitted one by one on the driver and are as few and short as the grid that named them, whatever
    the data. They are broadcast, so the inputs are read once and never moved.
    """
    used = models.select("model", F.col("n").alias("_n"), "layers", "epoch", "net", "trees")
    kept = [F.col(c) for c in inputs.columns if c not in ("conf", "pred", "vector", "model", "layers", "epoch")]
    rows = inputs.withColumn("_x", F.when(F.col("vector").isNotNull(), vector_to_array("vector")))
    conf = confidence(F.col("_x"), F.col("net"), F.col("trees")).alias("conf")
    scored = rows.join(F.broadcast(used), F.col("n") == F.col("_n")).select(*kept, "model", "layers", "epoch", conf)
    return scored.withColumn("pred", threshold("conf").cast("int"))


def epoch_metrics(models: DataFrame, held: DataFrame) -> DataFrame:
    """Metrics and mean loss of every model, epoch and split of ``held``, each row scored once."""
    by = [*MODEL_KEY, "split"]
    scored = score(models, held.where(F.col("split").isNotNull())).select(*by, "label", "pred", "conf")
    return binary_metrics(scored, by=by, also={"loss": log_loss()})
