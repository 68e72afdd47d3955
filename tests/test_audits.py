"""What the inner joins of the enrichment drop."""

import pytest

from housemark.operators import audits, run_analytics
from housemark.schemas import RUN_LOG

AT = "2024-01-01 00:00:0"


@pytest.fixture
def log(spark):
    rows = [
        ("n", "02 vCores", "w", "r1", "start", f"{AT}0"),
        ("n", "02 vCores", "w", "r1", "teardown", f"{AT}1"),
        ("n", "64 vCores", "w", "r1", "start", f"{AT}2"),
        ("n", "64 vCores", "w", "r2", "setup", f"{AT}3"),
        ("n", "64 vCores", "w", "r2", "teardown", f"{AT}4"),
        ("n", None, "w", "r3", "start", f"{AT}5"),
        (None, None, None, None, None, f"{AT}6"),
    ]
    names = "platform string, configuration string, workload_name string, run_timestamp string, stage_name string, at string"
    return spark.createDataFrame(rows, names).selectExpr("*", "timestamp(at) AS stage_time")


def test_unknown_values_are_listed_with_their_records_and_runs(log):
    found = {(r.dimension, r.value): (r.record_count, r.run_count) for r in audits.unmatched_records(log).collect()}
    assert found == {
        ("stage_name", "teardown"): (2, 2),
        ("stage_name", None): (1, 1),
        ("configuration", "64 vCores"): (3, 2),
        ("configuration", None): (2, 2),
    }


def test_balance_adds_up_to_the_joins(spark, log):
    row = audits.enrichment_balance(log).first()
    assert tuple(row) == (7, 1, 1, 3, 2)
    joined = run_analytics.join_configurations(run_analytics.join_stages(log))
    assert joined.count() == row.kept_count


def test_no_records(spark):
    log = spark.createDataFrame([], RUN_LOG)
    assert audits.unmatched_records(log).collect() == []
    assert tuple(audits.enrichment_balance(log).first()) == (0, 0, 0, 0, 0)


def test_counts_come_before_the_join(spark, path):
    spark.range(1000).selectExpr("id % 3 AS k").write.parquet(path)
    dimension = spark.createDataFrame([(0,), (0,), (5,)], "k long")
    found = audits.unmatched(spark.read.parquet(path), dimension, "k")
    assert sorted(map(tuple, found.collect())) == [(1, 333), (2, 333)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftAnti") < plan.index("count(1)")

