"""Stored sketches against exact figures."""

import random

import pytest
from pyspark.sql import functions as F

from housemark.operators import sketches


@pytest.fixture(scope="module")
def many(spark):
    """Skewed prices of 24 months, one of them with a third of all."""
    rows = spark.range(200_000).selectExpr(
        "if(id % 3 = 0, '2020_05', concat(2020 + id % 2, '_', lpad(id div 2 % 12 + 1, 2, '0'))) AS month_tag",
        "if(id % 7 = 0, 'D', 'S') AS property_type",
        "exp(6 + 8 * rand(4)) AS price",
    )
    return spark.createDataFrame(rows.collect(), rows.schema)


def rank_of(values, price):
    return sum(v <= price for v in values) / len(values)


@pytest.mark.parametrize("keys", [["year"], ["property_type"], ["year", "property_type"], []])
def test_rank_error_of_merged_groups(spark, store, many, keys):
    stored = store.overwrite(sketches.with_year(sketches.price_sketches(many)), "sketches")
    merged = sketches.merged_prices(stored, keys).collect()
    rows = sketches.with_year(many).collect()
    assert len(merged) == len({tuple(r[k] for k in keys) for r in rows})
    for group in merged:
        values = [r.price for r in rows if all(r[k] == group[k] for k in keys)]
        assert group.number_of_transactions == len(values)
        assert (group.min_price, group.max_price) == (min(values), max(values))
        for name, p in sketches.QUARTILES.items():
            # Twice the stated error: the bound holds for 99 of 100 sketches.
            assert abs(rank_of(values, group[name]) - p) <= 2 * sketches.RANK_ERROR


def test_small_groups_are_exact(spark):
    rng = random.Random(3)
    rows = [(f"2020_{m:02d}", k, float(rng.randrange(50))) for m in (1, 2, 12) for k in "DS" for _ in range(rng.randrange(1, 60))]
    frame = spark.createDataFrame(rows, "month_tag string, property_type string, price double")
    for group in sketches.merged_prices(sketches.price_sketches(frame), ["property_type"]).collect():
        values = sorted(p for _, k, p in rows if k == group.property_type)
        for name, p in sketches.QUARTILES.items():
            assert group[name] == values[-(-len(values) * int(100 * p) // 100) - 1]


def test_nulls_nan_and_no_rows(spark):
    rows = [("2020_01", None, 5.0), ("2020_02", None, None), (None, "D", float("nan")), ("bad", "S", 1.0)]
    frame = spark.createDataFrame(rows, "month_tag string, property_type string, price double")
    months = sketches.with_year(sketches.price_sketches(frame))
    found = {(r.year, r.property_type): r for r in sketches.merged_prices(months, ["year", "property_type"]).collect()}
    assert set(found) == {(2020, None), (None, "D"), (None, "S")}
    assert (found[2020, None].number_of_transactions, found[2020, None].median_price) == (2, 5.0)
    assert (found[None, "D"].number_of_transactions, found[None, "D"].median_price) == (1, None)
    assert sketches.merged_prices(sketches.price_sketches(frame.limit(0)), ["month_tag"]).collect() == []


def log(spark, runs):
    return spark.range(runs).select(
        F.concat(F.lit("r"), F.col("id")).alias("run_timestamp"),
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("platform"),
        F.lit("c").alias("configuration"),
        F.lit(None).cast("string").alias("workload_name"),
        F.lit(1).cast("long").alias("cu_per_second"),
        # Every run lies on two days.
        F.explode(F.array(F.col("id") % 28 + 1, F.col("id") % 28 + 2)).alias("day"),
    ).withColumn("stage_time", F.make_timestamp(F.lit(2024), F.lit(1), "day", F.lit(0), F.lit(0), F.lit(0)))


@pytest.mark.parametrize("days", [(1, 31), (5, 9)])
def test_runs_under_a_filter(spark, store, days):
    frame = log(spark, 60_000)
    stored = store.overwrite(sketches.run_sketches(frame), "runs")
    inside = F.dayofmonth("day").between(*days)
    chosen = frame.where(F.col("day").between(*days))
    for by in (["platform"], ["workload_name"], []):
        exact = chosen.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct("run_timestamp").alias("d"))
        exact = {tuple(r)[:-2]: (r.n, r.d) for r in exact.collect()}
        found = sketches.merged_runs(stored.where(inside), by).collect()
        assert {tuple(r)[:-2] for r in found} == set(exact)
        for row in found:
            n, d = exact[tuple(row)[:-2]]
            # Three standard errors.
            assert row.record_count == n and abs(row.run_count - d) <= 3 * 0.0082 * d


def test_runs_of_nothing(spark):
    none = sketches.run_sketches(log(spark, 0))
    assert sketches.merged_runs(none, ["platform"]).collect() == []
    assert tuple(sketches.merged_runs(none, []).first()) == (0, 0)


def test_merging_reads_the_stored_sketches_only(spark, store, many):
    stored = store.overwrite(sketches.price_sketches(many), "sketches")
    plan = sketches.merged_prices(stored, ["property_type"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "price_sketch" in plan and "price:double" not in plan.replace("min_price:double", "").replace("max_price:double", "")
