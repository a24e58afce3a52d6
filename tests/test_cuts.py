"""Cuts and slices against a plain sort."""

import math
import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from traceflow.operators import cuts, slices

SCHEMA = "b boolean, i long, d double, t string, m decimal(12,3), w timestamp, y date, k int"


@pytest.fixture(scope="module")
def rows(spark):
    """Nulls, extremes, ties, long equal prefixes, NaN and infinities."""
    rng = random.Random(4)

    def maybe(v):
        return None if rng.random() < 0.1 else v

    made = []
    for k in range(600):
        made.append(
            (
                maybe(rng.random() < 0.5),
                maybe(rng.choice([-(2**63), 2**63 - 1, 0, rng.randrange(-50, 50)])),
                maybe(rng.choice([math.nan, math.inf, -math.inf, 0.0, -0.0, 1e-300, 1e300, rng.random(), 7.5])),
                maybe(rng.choice(["", "a", "a\0", "ab", "prefix " * 4 + rng.choice("abc"), "é", "\U0001f600", "zz"])),
                maybe(Decimal(rng.randrange(-9000, 9000)) / 1000),
                maybe(datetime(2020, 1, 1) + timedelta(microseconds=rng.randrange(5))),
                maybe(date(2020, 1, 1) + timedelta(days=rng.randrange(-3, 3))),
                k,
            )
        )
    return spark.createDataFrame(made, SCHEMA).repartition(5).cache()


@pytest.mark.parametrize("order", [["b", "i"], ["d", "t"], ["m", "t"], ["w", "y", "k"]])
def test_cut(rows, order):
    ranked = [tuple(r) for r in rows.orderBy(*order).select(*order).collect()]
    for position in (-1, 61, 300, 600):
        found = cuts.cut(rows, order, position, few=20)
        before = [tuple(r) for r in rows.where(found.before).orderBy(*order).select(*order).collect()]
        doubt = [tuple(r) for r in rows.where(found.doubt).orderBy(*order).select(*order).collect()]
        assert (len(before), len(doubt)) == (found.n_before, found.n_doubt)
        assert str(before + doubt) == str(ranked[: len(before) + len(doubt)])
        assert len(before) <= max(0, position) <= max(len(before) + len(doubt), 0) or position > 600
        assert len(doubt) <= 20 or len({str(d) for d in doubt}) == 1


def test_keys_without_numbers_stay_in_doubt(spark):
    rows = spark.range(100).select(F.array("id").alias("a"), (F.col("id") % 2).alias("i"))
    found = cuts.cut(rows, ["i", "a"], 70, few=10)
    assert (found.n_before, found.n_doubt) == (50, 50)


@pytest.mark.parametrize("order", [["i", "t"], ["d"]])
@pytest.mark.parametrize("start,stop", [(250, 333), (590, 700)])
def test_slices_agree_with_a_top_k(rows, order, start, stop):
    whole = slices.position_slice(rows, order, start, stop)
    cut = slices.position_slice(rows, order, start, stop, top_rows=15)
    assert sorted(map(str, cut.collect())) == sorted(map(str, whole.collect()))
    assert sorted(r["pos"] for r in cut.collect()) == list(range(start, min(stop, 600)))
    lead = slices.leading_slice(rows, order, stop, top_rows=15)
    assert sorted(map(str, lead.collect())) == sorted(
        map(str, slices.position_slice(rows, order, 0, stop).drop("pos").collect())
    )


def test_only_the_slice_is_sorted(spark):
    """The exchange that sorts reads the rows between the cuts, not the table."""
    rows = spark.range(200_000).select((F.col("id") * 7919 % 200_000).alias("id"))
    found = cuts.cut(rows, ["id"], 100_000, few=100)
    assert found.n_before <= 100_000 < found.n_before + found.n_doubt <= 100_000 + 100
    lead = slices.leading_slice(rows, ["id"], 100_000, top_rows=100)
    plan = lead._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Scan ExistingRDD" not in plan
    assert lead.agg(F.max("id"), F.count("*")).first()[:] == (99_999, 100_000)
