"""Hard negatives against SQL on the tables (test_queries.py) and against plain code here."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceflow.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, score int, anchor int"


def plain(rows, every):
    """Rows (id, vector, label); distinct rows that share an id are rows of their own."""
    use = sorted(
        {
            (i, tuple(math.floor(256 * x) for x in v), y)
            for i, v, y in rows
            if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
        }
    )
    out = []
    for a, va, ya in use:
        if a % every:
            continue
        scored = [(-sum(p * q for p, q in zip(va, v)), i, y) for i, v, y in use if i != a and len(v) == len(va)]
        scored.sort()
        for s, i, _ in [x for x in scored if x[2] == ya][:5]:
            fits = [(-n, j) for n, j, y in scored if y != ya and 50 * -s <= 100 * -n <= 95 * -s]
            out += [(a, i, k + 1, j, -s, n) for k, (n, j) in enumerate(fits[:3])]
    return sorted(out)


def mined(df, every=3):
    return sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % every == 0).collect())


@pytest.mark.parametrize("block", [3, 1024])
def test_ties_gaps_and_repeats(spark, block, monkeypatch):
    """Few scores, so many ties; nulls in every column; repeated rows and ids; small blocks, tiles and cells."""
    rng = random.Random(block)
    monkeypatch.setattr(negatives, "TILE", 4)
    monkeypatch.setattr(negatives, "GROUP", 2)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.5, 1.0]) for _ in range(3)], rng.choice([0, 1, 2])) for i in range(60)]
    rows += rows[:9] + [(r[0], [0.5, 0.5, 0.25], r[2]) for r in rows[:6]] + [(r[0], r[1], 1) for r in rows[20:24]]
    rows += [(None, [1.0, 1.0, 1.0], 1), (90, None, 1), (93, [1.0, None, 1.0], 1), (96, [1.0, math.inf, 0.0], 1)]
    rows += [(99, [1.0, math.nan, 0.0], 1), (102, [1.0, 1.0, 1.0], None), (105, [], 1), (106, [], 1), (107, [], 2)]
    rows += [(108, [1.0, 0.5], 0), (109, [1.0, 0.5], 0), (110, [0.75, 0.5], 1)]
    df = spark.createDataFrame([(*r, 7, 7) for r in rows], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 3 == 0, block).collect())
    want = plain(rows, 3)
    assert got == want
    assert len(want) > 50 and {r[0] for r in want} >= {105, 108}


def test_empty_and_without_anchors(spark):
    df = spark.createDataFrame([(1, [1.0], 1, 0, 0)], SCHEMA)
    assert mined(df) == [] and mined(df.limit(0)) == []


def test_products_beyond_doubles_are_exact():
    left = np.array([[2.0**60, 1.0, 3.0]])
    right = np.array([[2.0**2, 5.0, 1.0], [2.0**60, 0.0, 0.0], [-(2.0**60), 0.0, 0.0]])
    assert negatives.scores(left, right).tolist() == [[2**62 + 8, 2**63 - 1, -(2**63 - 1)]]


def test_window_is_that_of_the_definition():
    for score in range(-300, 400):
        low, high = negatives.window(score)
        fits = [n for n in range(-500, 500) if 50 * score <= 100 * n <= 95 * score]
        assert fits == list(range(low, high + 1))


def test_one_label_and_copies(spark):
    """A hot label and many copies of one row: copies count once, one label has no negatives."""
    rows = [(i, [1.0, i / 50], 1, 0, 0) for i in range(50)] + [(7, [1.0, 0.14], 1, 0, 0)] * 200
    assert mined(spark.createDataFrame(rows, SCHEMA)) == []
    rows += [(100 + i, [0.7, i / 80], 2, 0, 0) for i in range(20)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == plain([r[:3] for r in rows], 3)


def test_plan_sorts_inside_partitions_of_the_anchor(spark):
    df = spark.createDataFrame([(i, [1.0, i / 9], i % 2, 0, 0) for i in range(30)], SCHEMA)
    plan = negatives.mine(df, F.col("vec_id") % 3 == 0)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(anchor" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
