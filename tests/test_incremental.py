"""Refreshing the analytics table batch by batch."""

import pytest
from pyspark.sql import functions as F

from housemark.operators import run_analytics
from housemark.operators.run_log import order_stages
from housemark.plans import incremental
from housemark.schemas import ONE_RUN, RUN_LOG
from housemark.sources import testdata
from housemark.sources.scratch import delete_tree, stage
from housemark.sources.tables import BATCH_COLUMN, TableStore

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def log(spark):
    records = testdata.run_records(spark, FOLDER)
    return stage(order_stages(records, bounded=True), "log")


@pytest.fixture(scope="module")
def parts(log):
    number = F.pmod(F.xxhash64(*ONE_RUN), F.lit(3))
    return [stage(log.where(number == i), "part") for i in range(3)]


def rows(frame):
    return sorted(map(str, frame.collect()))


def rebuilt(frame):
    return rows(run_analytics.enrich(frame, True))


def files(store, table="benchmark_analytics"):
    return {(r[BATCH_COLUMN], r.path) for r in store.batch_files(table).collect()}


def test_arrivals_and_a_retry_equal_the_full_rebuild(store, log, parts):
    for i, part in enumerate(parts):
        wrong = part.withColumn("memory_usage", F.lit(0.0)) if i == 1 else part
        store.append(wrong, "benchmarks", f"day {i}".replace(" ", "-"), RUN_LOG)
        found = incremental.refresh_analytics(store, True)
    assert rows(found) != rebuilt(log)
    before = files(store)
    store.append(parts[1], "benchmarks", "day-1", RUN_LOG)
    assert rows(incremental.refresh_analytics(store, True)) == rebuilt(log)
    # Only the late batch was written again.
    assert {batch for batch, _ in before ^ files(store)} == {"day-1"}


def test_nothing_new_writes_nothing(store, parts):
    store.append(parts[0], "benchmarks", "one", RUN_LOG)
    incremental.refresh_analytics(store, True)
    before = files(store)
    found = incremental.refresh_analytics(store, True)
    assert files(store) == before and rows(found) == rebuilt(parts[0])


def test_only_pending_batches_are_read(store, parts):
    for i, part in enumerate(parts):
        store.append(part, "benchmarks", f"b{i}", RUN_LOG)
    changed = stage(store.spark.createDataFrame([("b1", "pending"), ("b2", "gone")], "batch_id string, state string"))
    pending = incremental.pending_log(store, "benchmarks", changed)
    assert rows(pending.drop(BATCH_COLUMN)) == rows(parts[1])
    plan = pending._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "dynamicpruning" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]


def test_batch_that_is_gone_or_no_longer_known(store, parts):
    for i, part in enumerate(parts):
        store.append(part, "benchmarks", f"b{i}", RUN_LOG)
    incremental.refresh_analytics(store, True)
    store.append(parts[0].withColumn("configuration", F.lit("64 vCores")), "benchmarks", "b0", RUN_LOG)
    delete_tree(store.spark, f"{store.path('benchmarks')}/{BATCH_COLUMN}=b2", store.root)
    assert rows(incremental.refresh_analytics(store, True)) == rebuilt(parts[1])
    assert {batch for batch, _ in files(store)} == {"b1"}


def test_refresh_that_failed_before_its_ledger(store, parts, monkeypatch):
    store.append(parts[0], "benchmarks", "one", RUN_LOG)
    with monkeypatch.context() as patch:
        def broken(*arguments, **more):
            raise OSError("lost")

        patch.setattr(TableStore, "overwrite", broken)
        with pytest.raises(OSError):
            incremental.refresh_analytics(store, True)
    assert rows(incremental.refresh_analytics(store, True)) == rebuilt(parts[0])


def test_names_that_are_escaped_in_folders(store, parts):
    names = F.when(F.col("stage_name").isNotNull(), F.lit("a+b c=d/ö%"))
    store.append_batches(parts[0], "benchmarks", names, RUN_LOG)
    assert {batch for batch, _ in files(store, "benchmarks")} == {"a+b c=d/ö%"}
    assert rows(incremental.refresh_analytics(store, True)) == rebuilt(parts[0])


def test_no_log(store):
    found = incremental.refresh_analytics(store)
    assert found.collect() == [] and found.columns[-1] == "cumulative_time"


def test_windows_over_ranges_give_the_same(store, parts):
    store.append(parts[2], "benchmarks", "one", RUN_LOG)
    assert rows(incremental.refresh_analytics(store, bounded=False)) == rebuilt(parts[2])


def test_formats_with_their_own_transactions_are_refused(store):
    with pytest.raises(ValueError):
        TableStore(store.spark, store.root, "delta").batch_files("benchmarks")
