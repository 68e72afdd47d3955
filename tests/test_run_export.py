"""Bulk exports of the run log: batches that runs share, and runs written again."""

from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from housemark.operators import run_analytics
from housemark.operators.run_log import StageRecord, order_stages, records_frame
from housemark.plans import incremental, run_jobs
from housemark.schemas import ONE_RUN, RUN_LOG
from housemark.sources.scratch import stage
from housemark.sources.tables import BATCH_COLUMN, TableStore

START = datetime(2025, 1, 5, 12, 0, 0)
RUNS = 300


def record(run, seconds=0, memory=1.0, name="start", configuration="02 vCores"):
    at = START + timedelta(seconds=seconds)
    return StageRecord("single_node", configuration, "w", run, name, at, 2, 1.0, 16.0, memory)


def ordered(spark, records):
    return stage(order_stages(records_frame(spark, records), bounded=True), "log")


@pytest.fixture(scope="module")
def log(spark):
    found = [record(f"r{i}", s, name=n) for i in range(RUNS) for s, n in ((0, "start"), (4, "ingest"))]
    # Rows that come twice, and runs of which parts of the key are not known.
    found += [record("r0"), record(None), record(None), record("", 1), record(None, configuration=None)]
    return ordered(spark, found)


def rows(frame):
    return Counter(map(str, frame.collect()))


def files(store):
    return {(r[BATCH_COLUMN], r.path) for r in store.batch_files("benchmarks").collect()}


def batches(store):
    return {batch for batch, _ in files(store)}


@pytest.mark.parametrize("kind", ["parquet", "orc"])
def test_batches_do_not_grow_in_number_with_the_runs(spark, store, log, kind):
    store = TableStore(spark, store.root, kind)
    for _ in range(2):
        found = run_jobs.export_runs(log, store)
        assert rows(found) == rows(log)
        assert len(batches(store)) <= run_jobs.RUN_GROUPS < RUNS
        assert len(files(store)) < RUNS


def test_a_run_written_again_replaces_its_rows_alone(spark, store, log):
    run_jobs.export_runs(log, store)
    before = files(store)
    again = ordered(spark, [record("r7", memory=9.0), record(None, memory=9.0), record("new")])
    keys = [F.col(k).alias(f"k_{k}") for k in ONE_RUN]
    same = [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in ONE_RUN]
    left = log.join(again.select(*keys).distinct(), same, "left_anti")
    assert log.count() - left.count() == 4
    for _ in range(2):
        assert rows(run_jobs.export_runs(again, store)) == rows(left) + rows(again)
    # Groups without a row in the second log are not touched.
    written = {batch for batch, _ in before ^ files(store)}
    assert written == {r[0] for r in again.select(run_jobs.group_of_run()).collect()}


def test_an_empty_export_changes_nothing(store, log):
    assert run_jobs.export_runs(log.limit(0), store).isEmpty()
    run_jobs.export_runs(log, store)
    before = files(store)
    assert rows(run_jobs.export_runs(log.limit(0), store)) == rows(log)
    assert files(store) == before


def test_group_of_a_row_is_the_group_of_its_run(spark):
    runs = [("a", "b", "c", "d"), (None, "b", "", "ü☃"), (None,) * 4, ("ab", "", "c", "😀")]
    frame = spark.createDataFrame(runs, ", ".join(f"{k} string" for k in ONE_RUN))
    found = frame.select(*ONE_RUN, run_jobs.group_of_run().alias("g")).collect()
    assert {tuple(r)[:4]: r.g for r in found} == {r: run_jobs.group_name(r) for r in runs}


def test_recorded_and_exported_runs_replace_each_other(spark, store, log):
    def recorder(memory):
        return run_jobs.RunRecorder(
            spark, "single_node", "02 vCores", "w", START, probe=lambda: {"memory_usage": memory}
        )

    # Recorded, then exported with others: it stays in its batch.
    recorder(1.0).export(store)
    (own,) = batches(store)
    both = ordered(spark, recorder(2.0).records).unionByName(log)
    assert rows(run_jobs.export_runs(both, store)) == rows(both)
    assert {b for b in batches(store) if not b.startswith("runs~")} == {own}
    # Exported, then recorded: it is replaced in its group.
    run_jobs.export_runs(both, store, "other")
    recorder(3.0).export(store, "other")
    wanted = rows(ordered(spark, recorder(3.0).records).unionByName(log))
    assert rows(store.read_appended("other", RUN_LOG)) == wanted


def test_analytics_follow_exported_groups(spark, store, log):
    run_jobs.export_runs(log, store)
    incremental.refresh_analytics(store, True)
    table = stage(run_jobs.export_runs(ordered(spark, [record("r7", memory=9.0)]), store), "table")
    assert rows(incremental.refresh_analytics(store, True)) == rows(run_analytics.enrich(table, True))
