"""Measures under several groupings at once against the single measures."""

import pytest
from pyspark.sql import functions as F

from housemark.operators import measures, run_analytics
from housemark.operators.run_log import order_stages
from housemark.sources import testdata
from housemark.sources.scratch import stage

FOLDER = "/root/testdata/sf0.001"
SINGLE = {
    "run_count": measures.run_count,
    "total_time": measures.total_time,
    "average_time": measures.average_time,
    "median_time": measures.median_time,
    "average_cost": measures.average_cost,
    "median_cost": measures.median_cost,
}


@pytest.fixture(scope="module")
def analytics(spark):
    log = order_stages(testdata.run_records(spark, FOLDER), bounded=True)
    found = run_analytics.enrich(log, True)
    # Groups with a NULL label, and runs in which nothing was measured.
    odd = F.pmod(F.xxhash64("run_timestamp"), F.lit(5))
    return stage(
        found.withColumn("workload_name", F.when(odd != 1, F.col("workload_name"))).withColumn(
            "stage_time_delta", F.when(odd != 2, F.col("stage_time_delta"))
        ),
        "analytics",
    )


def test_every_context_equals_the_single_measures(analytics):
    found = measures.measures_by_context(analytics).collect()
    for context in measures.CONTEXTS:
        mine = [r for r in found if r.context == ",".join(context)]
        for name, measure in SINGLE.items():
            by = list(context) or ["nothing"]
            single = measure(analytics.withColumn("nothing", F.lit(0)), by=by).collect()
            wanted = sorted((str([r[c] for c in context]), r[name]) for r in single)
            assert sorted((str([r[c] for c in context]), r[name]) for r in mine) == wanted
        assert all(r[c] is None for r in mine for c in measures.CONTEXTS[0] if c not in context)
    assert {r.context for r in found} == {",".join(c) for c in measures.CONTEXTS}


def test_a_group_without_a_measured_run(spark, analytics):
    unmeasured = analytics.withColumn("stage_time_delta", F.lit(None).cast("double"))
    rows = measures.measures_by_context(unmeasured, [["platform"], []]).collect()
    assert rows and all(r.run_count > 0 and r.total_time is r.median_cost is r.average_time is None for r in rows)


def test_no_rows(analytics):
    assert measures.measures_by_context(analytics.limit(0)).collect() == []


def test_the_log_is_read_once_for_all_contexts(spark, analytics):
    """Further contexts cost no further jobs."""
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext

    def jobs(contexts):
        name = f"contexts-{len(contexts)}"
        context.setJobGroup(name, name)
        measures.measures_by_context(analytics, contexts)
        context.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(name))

    one, five = jobs([["platform"]]), jobs(measures.CONTEXTS)
    assert 0 < five <= one + 1
