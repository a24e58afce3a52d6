"""The physical plans: what is shuffled, broadcast and read."""

import re

from traceflow.operators import history, joins, metrics, ranking, splits
from traceflow.plans.catalog import queries
from traceflow.sources import testtables as tt

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sequences_shuffle_attempts_once(spark):
    plan = plan_of(queries()["sequences_n5"](spark, SF))
    exchanges = re.findall(r"Exchange hashpartitioning\((\w+)#", plan)
    assert exchanges.count("student_id") == 1
    assert set(exchanges) == {"student_id", "id"}
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan
    assert "SinglePartition" not in plan


def test_split_join_reuses_the_partitioning(spark):
    plan = plan_of(queries()["sequences_by_split"](spark, SF))
    rows = [p for p in re.findall(r"Exchange hashpartitioning\(([^\n]*)", plan) if "chunk" in p]
    assert rows == []


def test_scan_reads_only_used_columns(spark):
    plan = plan_of(queries()["questions_per_student"](spark, SF))
    assert "ReadSchema: struct<user_id:bigint>" in plan
    assert "IsNotNull(user_id)" in plan
    plan = plan_of(queries()["kc_first"](spark, SF))
    assert "l_extendedprice" not in plan


def test_no_unpartitioned_window_on_rows(spark):
    students = tt.attempts(spark, SF)
    plan = plan_of(splits.student_split(students))
    # The only single-partition step is the running sum over hash buckets.
    assert plan.count("Exchange SinglePartition") == 1
    assert re.search(r"Window \[[^\n]*_bucket#", plan)
    rows = spark.range(1000)
    placed = ranking.ordered_positions(rows, [rows["id"].asc()])
    assert "rangepartitioning" not in plan_of(placed)


def test_metrics_are_one_aggregate(spark):
    rows = tt.scored_lines(spark, SF).withColumn("pred", (tt.F.col("conf") > 0.5).cast("int"))
    plan = plan_of(metrics.binary_metrics(rows))
    assert plan.count("Exchange") == 1 and plan.count("Scan parquet") == 1


def test_large_lookup_is_not_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = tt.attempts(spark, SF)
        small = history.with_difficulty(rows, tt.questions(spark, SF))
        large = history.with_difficulty(rows, tt.questions(spark, SF), max_rows=10)
        assert "BroadcastHashJoin" in plan_of(small)
        assert "BroadcastHashJoin" not in plan_of(large)
        assert joins.hot_keys(rows, "student_id") is None
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
