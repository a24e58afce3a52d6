import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import rows_of
from traceflow.operators import joins, ranking, sampling, slices, splits


def test_fold_sizes(spark):
    students = spark.range(1, 21).toDF("student_id")
    found = splits.student_split(students)
    sizes = {r["block"]: r["count"] for r in found.groupBy("block").count().collect()}
    assert sizes == {"0": 6, "1": 6, "2": 5, "test": 3}
    assert sorted(r["pos"] for r in found.collect()) == list(range(20))


@settings(max_examples=15, deadline=None)
@given(count=st.integers(1, 60), folds=st.integers(1, 7))
def test_folds_are_contiguous(spark, count, folds):
    rows = spark.range(count).select(
        "id", splits.fold_of(F.col("id"), F.lit(count).cast("long"), folds).alias("fold")
    )
    found = [r["fold"] for r in rows.orderBy("id").collect()]
    sizes = [found.count(f) for f in range(folds)]
    assert found == sorted(found)
    assert sum(sizes) == count and max(sizes) - min(sizes) <= 1
    assert sizes == sorted(sizes, reverse=True)


def test_split_is_leakage_free_and_complete(spark):
    rows = spark.range(1000).select((F.col("id") % 137).alias("student_id"))
    found = splits.student_split(rows)
    assert found.count() == 137 == found.select("student_id").distinct().count()
    members = splits.expand_folds(found)
    for fold in (1, 2, 3):
        part = members.where(F.col("fold").isin(fold, 0))
        assert part.count() == 137
        assert part.select("student_id").distinct().count() == 137
    train = found.where(splits.in_training(1)).select("student_id")
    held = found.where(splits.in_validation(1) | splits.in_test()).select("student_id")
    assert train.intersect(held).count() == 0
    assert train.count() + held.count() == 137


def test_split_needs_no_row_order(spark):
    rows = spark.range(200).toDF("student_id")
    mixed = rows.orderBy(F.rand(3)).repartition(5)
    assert rows_of(splits.student_split(rows)) == rows_of(splits.student_split(mixed))


def test_attach_split(spark):
    rows = spark.range(100).select((F.col("id") % 5).alias("student_id"), "id")
    split = splits.student_split(rows.where("student_id != 3"))
    found = splits.attach_split(rows, split, ["id"])
    assert found.count() == 80 and "block" in found.columns


@pytest.mark.parametrize("digits", [1, 3, (1, 1), (2, 3), (1, 1, 1)])
def test_hash_positions(spark, digits):
    rows = spark.range(500).withColumn("weight", F.col("id") % 4)
    expected = sorted(range(500), key=lambda i: (hashlib.md5(f"7:{i}".encode()).hexdigest(), i))
    found = ranking.hash_positions(rows, ["id"], 7, digits=digits, total="total")
    placed = {r["id"]: r["pos"] for r in found.collect()}
    assert [placed[i] for i in expected] == list(range(500))
    assert found.first()["total"] == 500
    weighted = ranking.hash_positions(rows, ["id"], 7, weight="weight", digits=digits)
    starts = {r["id"]: r["pos"] for r in weighted.collect()}
    running = 0
    for i in expected:
        assert starts[i] == running
        running += i % 4


def test_levels_follow_the_rows():
    assert ranking.levels_for(0) == ranking.levels_for(10**9) == (3,)
    assert ranking.levels_for(10**12) == (2, 3)
    assert ranking.levels_for(10**15) == (2, 3, 3)
    assert ranking.levels_for(5000, bucket_rows=1) == (1, 3)


def test_planned_rows_are_a_guess_from_above(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    assert 0 < ranking.planned_rows(read) < 10**6
    assert ranking.planned_rows(read.join(read.withColumn("k", F.lit(1)), "id")) < 10**6


def test_no_window_of_buckets_outgrows_a_level(spark):
    totals = spark.range(16**4).select(F.lpad(F.lower(F.hex("id")), 4, "0").alias("_bucket"), F.col("id").alias("_amount"))
    placed = ranking.running_totals(totals, (1, 1, 2))
    wrong = placed.withColumn("id", F.conv("_bucket", 16, 10).cast("long")).where("_offset <> id * (id - 1) / 2")
    assert wrong.count() == 0 and placed.count() == 16**4
    assert placed.select("_total").distinct().collect() == [(16**4 * (16**4 - 1) // 2,)]


@pytest.mark.parametrize("bucket_rows", [1, 10])
def test_downsample_counts_a_full_bucket_again(spark, bucket_rows):
    rows = spark.range(600).withColumn("y", (F.col("id") % 4 > 0).cast("int"))
    found = sampling.downsample(rows, "y", ["id"], seed=5, digits=1, bucket_rows=bucket_rows)
    ones = [i for i in range(600) if i % 4]
    ones.sort(key=lambda i: (hashlib.md5(f"5:{i}".encode()).hexdigest(), i))
    assert sorted(r["id"] for r in found.where("y = 1").collect()) == sorted(ones[:150])


def test_ordered_positions(spark):
    rows = spark.range(3000).select(((F.col("id") * 7919) % 3000).alias("id"))
    found = ranking.ordered_positions(rows, [F.col("id").desc()])
    assert found.where(F.col("pos") != 2999 - F.col("id")).count() == 0
    assert found.count() == 3000


@pytest.mark.parametrize("top_rows", [0, 10_000])
def test_slices(spark, top_rows):
    rows = spark.range(100).select((99 - F.col("id")).alias("id"))

    def ids(df):
        return sorted(r["id"] for r in df.collect())

    assert ids(slices.leading_slice(rows, ["id"], 7, top_rows=top_rows)) == list(range(7))
    assert slices.leading_slice(rows, ["id"]).count() == 100
    cut = slices.leading_slice(rows, ["id"], -3, compat=True, top_rows=top_rows)
    assert ids(cut) == list(range(97))
    with pytest.raises(ValueError):
        slices.leading_slice(rows, ["id"], -1)
    part = slices.position_slice(rows, ["id"], 55, 66, top_rows=top_rows)
    assert ids(part) == list(range(55, 66))


@pytest.mark.parametrize("ones,zeros,kept", [(5, 2, (2, 2)), (1, 3, (1, 3)), (4, 0, (0, 0))])
@pytest.mark.parametrize("digits", [1, 3])
def test_downsample_counts(spark, ones, zeros, kept, digits):
    labels = [1] * ones + [0] * zeros + [2]
    rows = spark.createDataFrame(list(enumerate(labels)), "id long, y int")
    found = [r["y"] for r in sampling.downsample(rows, "y", ["id"], digits=digits).collect()]
    assert (found.count(1), found.count(0), found.count(2)) == (*kept, 0)


def test_downsample_takes_first_in_hash_order(spark):
    rows = spark.range(400).withColumn("y", (F.col("id") % 4 > 0).cast("int"))
    found = sampling.downsample(rows, "y", ["id"], seed=5, digits=1)
    ones = [i for i in range(400) if i % 4]
    ones.sort(key=lambda i: (hashlib.md5(f"5:{i}".encode()).hexdigest(), i))
    assert sorted(r["id"] for r in found.where("y = 1").collect()) == sorted(ones[:100])
    assert found.where("y = 0").count() == 100


def test_shuffled(spark):
    found = [r["id"] for r in sampling.shuffled(spark.range(50), ["id"], 1).collect()]
    assert found == sorted(range(50), key=lambda i: hashlib.md5(f"1:{i}".encode()).hexdigest())


def test_hot_keys_and_salted_join(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") < 1000, 1).otherwise(F.col("id")).alias("k"), "id"
    )
    hot = joins.hot_keys(rows, "k", min_rows=100)
    assert [tuple(r) for r in hot.collect()] == [(1, 1000)]
    assert joins.hot_keys(rows, "k", min_rows=1000) is None
    lookup = spark.range(0, 3000, 2).select(F.col("id").alias("k"), F.lit("x").alias("v")).union(
        spark.createDataFrame([(1, "hot")], "k long, v string")
    )
    for how in ("left", "inner"):
        plain = rows.join(lookup, "k", how)
        salted = joins.lookup_join(
            rows, lookup, "k", how, row_key=["id"], max_rows=0, hot_rows=100
        )
        assert rows_of(salted, "k", "id", "v") == rows_of(plain, "k", "id", "v")


def test_broadcast_needs_a_measured_size(spark):
    small = spark.createDataFrame([(1, "x" * 100)], "k long, v string")
    assert joins.fits_broadcast(small)
    assert not joins.fits_broadcast(small, max_bytes=50)
    assert not joins.fits_broadcast(small, max_rows=0)
