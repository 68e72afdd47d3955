"""What the physical plans must, and must not, contain."""

import pytest

from housemark.operators import run_analytics, star_schema, summaries
from housemark.operators.run_log import order_stages
from housemark.schemas import DATES, PRICES
from housemark.sources import testdata

FOLDER = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def facts(spark, store):
    clean = star_schema.clean_price_paid(testdata.price_paid_raw(spark, FOLDER))
    prices = store.overwrite(star_schema.prices_fact(clean), "prices")
    store.overwrite(star_schema.dates_dim(star_schema.date_bounds(prices)), "dates", files=1)
    return store


def test_join_broadcasts_a_small_calendar_and_pushes_the_filter(facts):
    prices = star_schema.without_other(facts.read("prices", PRICES))
    dates = star_schema.with_month_tag(facts.read("dates", DATES))
    text = plan(summaries.monthly_summary_approx(summaries.join_dates(prices, dates)))
    assert "BroadcastHashJoin [date_of_transfer" in text
    assert "Not(EqualTo(property_type,Other))" in text
    assert "ReadSchema: struct<price:double,date_of_transfer:date,property_type:string>" in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_large_calendar_is_shuffled(spark, facts):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        prices = star_schema.without_other(facts.read("prices", PRICES))
        dates = star_schema.with_month_tag(facts.read("dates", DATES))
        assert "SortMergeJoin" in plan(summaries.join_dates(prices, dates))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_log_windows_are_partitioned(spark):
    log = order_stages(testdata.run_records(spark, FOLDER), bounded=True)
    text = plan(run_analytics.enrich(log, bounded=True))
    assert "SinglePartition" not in text
    # Three literal tables.
    assert text.count("BroadcastHashJoin") == 3


def test_previews_keep_few_rows_per_task(spark):
    frame = spark.range(1000).toDF("a")
    assert "TakeOrderedAndProject" in plan(summaries.preview(frame, ["a"]))
    assert "TakeOrderedAndProject" in plan(summaries.sample_rows(frame))
