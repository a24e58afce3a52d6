"""Models as rows against the models they were made of, and against SQL over the same rows."""

import duckdb
import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from traceflow.operators import linear, models, modeltables

WIDTH = 4


@pytest.fixture(scope="module")
def inputs(spark):
    """Coarse and fine numbers, so that thresholds are met exactly and between values."""
    x = [F.floor(F.rand(i) * 3) if i % 2 else F.rand(i) for i in range(WIDTH)]
    rows = spark.range(600).select("id", F.array(*[v.cast("double") for v in x]).alias("x"))
    label = ((F.col("x")[0] * 2 + F.col("x")[1] - F.col("x")[2] + F.rand(9)) > 1.5).cast("int")
    made = rows.select("id", label.alias("label"), array_to_vector("x").alias("vector"), F.lit(2).alias("n")).cache()
    made.count()
    return made


def conf_by_id(scored):
    return {r["id"]: r["conf"] for r in scored.collect()}


@pytest.mark.parametrize("family,depth", [("trees", 1), ("trees", 3), ("layers", 1), ("layers", 3)])
def test_rows_score_as_the_model_does(spark, inputs, family, depth):
    fitted = models.fit(inputs, family, depth, width=WIDTH, hidden=5, iterations=6)
    as_rows = modeltables.from_trees if family == "trees" else modeltables.from_layers
    table = as_rows(spark, fitted, (family, 2, depth, 0))
    want = conf_by_id(models.predict(fitted, inputs))
    got = conf_by_id(modeltables.score(table, inputs))
    assert got.keys() == want.keys() and len(set(want.values())) > 1
    assert max(abs(got[i] - want[i]) for i in want) < 1e-9


def test_a_leaf_alone(spark, inputs):
    """Labels that are all equal give trees without a test."""
    fitted = models.fit(inputs.withColumn("label", F.lit(1)), "trees", 2, iterations=2)
    table = modeltables.from_trees(spark, fitted, ("trees", 2, 2, 0))
    want = conf_by_id(models.predict(fitted, inputs))
    assert conf_by_id(modeltables.score(table, inputs)) == pytest.approx(want, abs=1e-9)


def test_nodes_in_sql(spark, inputs):
    fitted = models.fit(inputs, "trees", 3, iterations=4)
    table = modeltables.from_trees(spark, fitted, ("trees", 2, 3, 0))
    con = duckdb.connect()
    con.register("nodes", modeltables.node_rows(table).toPandas())
    con.register("inputs", inputs.select("id", vector_to_array("vector").alias("x")).toPandas())
    found = con.sql("""
        WITH RECURSIVE way AS (
            SELECT id, x, tree, 0 AS node FROM inputs, (SELECT DISTINCT tree FROM nodes)
            UNION ALL
            SELECT id, x, tree, CASE WHEN x[feature::INT + 1] <= threshold THEN low ELSE high END
            FROM way JOIN nodes USING (tree, node) WHERE low >= 0)
        SELECT id, 1 / (1 + exp(-2 * sum(tree_weight * value))) FROM way JOIN nodes USING (tree, node)
        WHERE low < 0 GROUP BY id""").fetchall()
    assert conf_by_id(modeltables.score(table, inputs)) == pytest.approx(dict(found), abs=1e-9)


def test_weights_are_rows(spark, inputs):
    fitted = models.fit(inputs, "layers", 1, width=WIDTH, hidden=3, iterations=5)
    rows = modeltables.weight_rows(modeltables.from_layers(spark, fitted, ("layers", 2, 1, 0))).collect()
    net = {(r["layer"], r["unit"], r["input"]): r["weight"] for r in rows}
    assert len(net) == 3 * (WIDTH + 1) + 4
    x = np.array(inputs.orderBy("id").first()["vector"].toArray())
    hidden = [1 / (1 + np.exp(-(net[0, u, 0] + sum(net[0, u, i + 1] * x[i] for i in range(WIDTH))))) for u in range(3)]
    z = net[1, 0, 0] + sum(net[1, 0, u + 1] * hidden[u] for u in range(3))
    assert models.predict(fitted, inputs.orderBy("id").limit(1)).first()["conf"] == pytest.approx(1 / (1 + np.exp(-z)))


def test_all_families_in_one_pass(spark, inputs, tmp_path):
    """A table that was written scores every model at once, without a Python worker or an exchange of the inputs."""
    straight = linear.fit(inputs, 2, (1, 2), epochs=2, steps=4)
    table = modeltables.from_linear(straight)
    for family, as_rows in (("trees", modeltables.from_trees), ("layers", modeltables.from_layers)):
        fitted = models.fit(inputs, family, 1, width=WIDTH, iterations=3)
        table = table.unionByName(as_rows(spark, fitted, (family, 2, 1, 0)))
    table.write.parquet(str(tmp_path / "models"))
    read = spark.read.schema(modeltables.TABLE).parquet(str(tmp_path / "models"))
    scored = modeltables.score(read, inputs)
    assert scored.count() == 6 * inputs.count()
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    want = {(r["id"], r["layers"], r["epoch"]): r["conf"] for r in linear.score(straight, inputs).collect()}
    got = {(r["id"], r["layers"], r["epoch"]): r["conf"] for r in scored.where("model = 'linear'").collect()}
    assert got == pytest.approx(want, abs=1e-12)
    # Rows of another length have no model, a missing vector has no score.
    assert modeltables.score(read, inputs.withColumn("n", F.lit(3))).count() == 0
    none = modeltables.score(read, inputs.limit(1).withColumn("vector", F.lit(None).cast(inputs.schema["vector"].dataType)))
    assert [(r["conf"], r["pred"]) for r in none.collect()] == [(None, None)] * 6
