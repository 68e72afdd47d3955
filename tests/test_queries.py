"""Every registered query against its SQL."""

import pytest
from oracle_check import connect, differences

import __spark_entry__ as entry
from housemark.operators import summaries
from housemark.plans import registry
from housemark.plans.oracle import oracle_sql as oracle_queries

FOLDER = "/root/testdata/sf0.001"
ROWS_ONLY = {"raw_inventory", "raw_preview"}


@pytest.fixture(scope="module")
def oracle():
    return connect(FOLDER)


def test_only_two_queries_have_no_sql():
    assert set(registry.queries()) - set(oracle_queries()) == ROWS_ONLY
    assert set(oracle_queries()) <= set(registry.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(oracle_queries()))
def test_equals_sql_without_python_or_cross_joins(spark, oracle, name):
    frame = entry.queries()[name](spark, FOLDER)
    text = frame._jdf.queryExecution().executedPlan().toString()
    for node in ("EvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text
    assert not differences(frame, oracle, entry.oracle_sql()[name])


@pytest.mark.parametrize("name, rows", [("raw_preview", 5), ("raw_inventory", 1)])
def test_rows_only(spark, name, rows):
    assert entry.queries()[name](spark, FOLDER).count() == rows


def test_rows_come_from_the_input(spark):
    whole = summaries.with_month_and_year(registry._raw(spark, FOLDER))
    found = entry.queries()["raw_preview"](spark, FOLDER)
    assert found.columns == whole.columns
    assert {tuple(r) for r in found.collect()} <= {tuple(r) for r in whole.collect()}


def test_rank_error_of_the_approximate_median(spark):
    frame = spark.range(50_000).selectExpr("'m' AS month_tag", "'D' AS property_type", "double(id) AS price")
    median = summaries.monthly_summary_approx(frame, accuracy=100).first().median_price
    assert abs(median - 25_000) <= 50_000 / 100


def test_entry(spark):
    assert entry.entry(spark).columns == [
        "month_tag",
        "property_type",
        "number_of_transactions",
        "median_price",
        "min_price",
        "max_price",
    ]
