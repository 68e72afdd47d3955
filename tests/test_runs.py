"""Run log, enrichment, report and measures on rows made by hand."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from housemark import schemas
from housemark.functions.runs import run_started_at, whole_milliseconds
from housemark.operators import measures, run_analytics
from housemark.operators.run_log import StageRecord, derive_configuration, order_stages, records_frame
from housemark.plans import price_jobs, run_jobs, views
from housemark.session import size_settings
from housemark.sources import price_files, testdata

START = datetime(2025, 1, 5, 12, 0, 0)


def record(configuration, run, stage, seconds, platform="single_node", memory=1.0):
    return StageRecord(
        platform, configuration, "w", run, stage, START + timedelta(seconds=seconds), 2, 1.0, 16.0, memory
    )


RUNS = [
    # Two runs of one configuration: elapsed 10 and 20, execution 6 and 14.
    record("02 vCores", "r1", "start", 0),
    record("02 vCores", "r1", "setup", 4),
    record("02 vCores", "r1", "ingest", 10),
    record("02 vCores", "r2", "start", 0),
    record("02 vCores", "r2", "setup", 6),
    record("02 vCores", "r2", "ingest", 12),
    record("02 vCores", "r2", "transform", 20, memory=9.0),
    # A run with one stage, and one without configuration row.
    record("04 vCores", "r3", "start", 0),
    record("64 vCores", "r4", "start", 0),
    record("64 vCores", "r4", "ingest", 5),
    record("01 executors 08/08 cores 56g/56g memory", "r5", "start", 0, "cluster"),
    record("01 executors 08/08 cores 56g/56g memory", "r5", "ingest", 30, "cluster"),
    record("01 executors 08/08 cores 56g/56g memory", "r5", "unknown stage", 40, "cluster"),
]


@pytest.fixture(scope="module")
def log(spark):
    return order_stages(records_frame(spark, RUNS)).cache()


@pytest.fixture(scope="module")
def analytics(log):
    return run_analytics.enrich(log).cache()


def by(frame, *keys):
    return {tuple(r[k] for k in keys): r for r in frame.collect()}


def test_order_and_delta(log):
    assert log.schema.simpleString() == schemas.RUN_LOG.simpleString()
    rows = by(log, "run_timestamp", "order")
    assert rows["r1", 1].stage_time_delta is None
    assert (rows["r1", 3].stage_name, rows["r1", 3].stage_time_delta) == ("ingest", 6.0)
    assert rows["r3", 1].stage_time_delta is None


def test_equal_times_are_ordered_by_name(spark):
    log = order_stages(records_frame(spark, [record("c", "r", s, 1) for s in ("b", "a")]))
    rows = by(log, "order")
    assert (rows[1,].stage_name, rows[2,].stage_name) == ("a", "b")
    assert rows[2,].stage_time_delta == 0.0


def test_milliseconds_round_half_up(spark):
    frame = spark.createDataFrame([(499,), (500,), (1499,), (1500,), (None,)], "us long")
    assert [r[0] for r in frame.select(whole_milliseconds(F.col("us"))).collect()] == [0, 1, 1, 2, None]


def test_sliced_runs_give_the_same_log(spark, log):
    sliced = order_stages(records_frame(spark, RUNS))
    assert sorted(map(str, sliced.collect())) == sorted(map(str, log.collect()))
    a = run_analytics.enrich(log)
    b = run_analytics.enrich(log, bounded=True)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_inner_joins_drop_unknown_rows(analytics):
    assert set(schemas.RUN_LOG.fieldNames()) < set(analytics.columns)
    assert len(analytics.columns) == 19
    rows = analytics.collect()
    assert "64 vCores" not in {r.configuration for r in rows}
    assert "unknown stage" not in {r.stage_name for r in rows}
    assert len(rows) == 10


def test_cumulative_time_starts_with_null(analytics):
    rows = by(analytics, "run_timestamp", "order")
    assert [rows["r2", i].cumulative_time for i in (1, 2, 3, 4)] == [None, 6.0, 12.0, 20.0]


def test_last_cumulative_time_is_the_elapsed_time(analytics):
    last = analytics.groupBy("run_timestamp").agg(F.max("cumulative_time").alias("c"))
    elapsed = by(run_analytics.elapsed_per_run(analytics), "run_timestamp")
    for row in last.collect():
        assert elapsed[row.run_timestamp,].total_elapsed_time == (row.c or 0.0)


def test_totals_per_run(analytics):
    elapsed = by(run_analytics.elapsed_per_run(analytics), "run_timestamp")
    assert [elapsed[r,].total_elapsed_time for r in ("r1", "r2", "r3")] == [10.0, 20.0, 0.0]
    execution = by(run_analytics.execution_per_run(analytics), "run_timestamp")
    assert {k[0]: r.total_execution_time for k, r in execution.items()} == {"r1": 6.0, "r2": 14.0, "r5": 30.0}


def test_medians_and_costs(analytics):
    assert by(run_analytics.median_elapsed(analytics), "configuration")["02 vCores",].median_elapsed_time == 15.0
    cost = by(run_analytics.unit_cost(analytics), "configuration")
    assert cost["02 vCores",].total_cu_cost == 10.0
    cluster = cost["01 executors 08/08 cores 56g/56g memory",]
    assert cluster.total_cu_cost == cluster.median_execution_time * 8 == 240.0


def test_rankings(analytics):
    fast = run_analytics.fastest(run_analytics.median_execution(analytics)).collect()
    assert [(r.rank, r.median_execution_time, r.percentage_of_min_time) for r in fast] == [
        (1, 10.0, 100.0),
        (2, 30.0, 300.0),
    ]
    cheap = run_analytics.cheapest(run_analytics.unit_cost(analytics), rows=1).collect()
    assert [(r.rank, r.total_cu_cost, r.percentage_of_min_cost) for r in cheap] == [(1, 10.0, 100.0)]
    default = run_analytics.default_environments(run_analytics.median_elapsed(analytics)).collect()
    assert [(r.median_elapsed_time, r.percentage_of_min_time) for r in default] == [(15.0, 100.0), (30.0, 200.0)]


def test_joins_of_time_and_cost(analytics):
    row = by(run_analytics.elapsed_vs_cost(analytics), "configuration")["02 vCores",]
    assert (row.median_total_elapsed_time, row.median_execution_time, row.total_cu_cost) == (15.0, 10.0, 10.0)
    row = by(run_analytics.execution_vs_cost(analytics), "configuration")["02 vCores",]
    assert row.median_total_execution_time == row.median_execution_time == 10.0


def test_provisioning(analytics):
    row = run_analytics.provisioning_median(analytics).collect()[0]
    assert (row.configuration, row.median_provisioning_time) == ("02 vCores", 5.0)
    box = run_analytics.provisioning_boxplot(analytics).collect()[0]
    assert [box[n] for n in run_analytics.FIVE_NUMBERS] == [4.0, 4.5, 5.0, 5.5, 6.0]


def test_cumulative_median_leaves_rows_out_but_not_time(analytics):
    rows = by(run_analytics.stage_cumulative_median(analytics), "configuration", "stage_name")
    assert rows["02 vCores", "ingest"].median_cumulative_time == 11.0
    assert ("02 vCores", "setup") not in rows


def test_measures(analytics):
    key = ("02 vCores",)
    assert by(measures.total_time(analytics), "configuration")[key].total_time == 30.0
    assert by(measures.average_time(analytics), "configuration")[key].average_time == 15.0
    assert by(measures.median_time(analytics), "configuration")[key].median_time == 15.0
    assert by(measures.run_count(analytics), "configuration")[key].run_count == 2
    assert by(measures.run_count(analytics, approximate=True), "configuration")[key].run_count == 2
    assert by(measures.average_cost(analytics), "configuration")[key].average_cost == 15.0
    assert by(measures.median_cost(analytics), "configuration")[key].median_cost == 15.0
    # Blank, not zero, where nothing was measured.
    blank = ("04 vCores",)
    assert by(measures.total_time(analytics), "configuration")[blank].total_time is None
    assert by(measures.average_time(analytics), "configuration")[blank].average_time is None
    assert by(measures.median_time(analytics), "configuration")[blank].median_time is None


def test_report_measures(analytics):
    stage = by(measures.median_stage_time(analytics), "configuration", "stage_name")
    assert stage["02 vCores", "ingest"].median_stage_time == 6.0
    assert ("02 vCores", "setup") not in stage
    point = by(measures.time_cost_scatter(analytics), "configuration")["02 vCores",]
    assert (point.median_time, point.median_cost, point.run_count) == (10.0, 10.0, 2)
    memory = by(run_analytics.max_memory_by_stage(analytics), "configuration", "stage_name")
    assert memory["02 vCores", "transform"].max_memory_usage == 9.0
    detail = by(run_analytics.run_detail(analytics), "run_timestamp", "stage_name")
    assert detail["r5", "ingest"].sum_cu_per_second == 8


def test_scatter_keeps_groups_without_a_label(analytics):
    unnamed = analytics.withColumn("platform", F.lit(None).cast("string"))
    assert measures.time_cost_scatter(unnamed).count() == measures.time_cost_scatter(analytics).count()


def test_wall_clock(log):
    assert by(run_analytics.run_wall_clock(log), "run_timestamp")["r2",].wall_clock_ms == 20_000


def test_profile(log):
    rows = by(run_analytics.profile(log), "column_name")
    assert len(rows) == 12
    delta = rows["stage_time_delta",]
    assert (delta.value_count, delta.null_count, delta.minimum, delta.maximum) == (8, 5, 4.0, 30.0)
    assert delta.median == 6.0
    name = rows["stage_name",]
    assert (name.first_text, name.last_text, name.mean) == ("ingest", "unknown stage", None)


def test_configurations_are_derived(spark):
    rows = [(64, None, None, None, None, None), (None, 2, 8, 8, "56g", "56g")]
    settings = spark.createDataFrame(
        rows,
        "v_cores int, executor_number int, driver_cores int, executor_cores int, "
        "driver_memory string, executor_memory string",
    )
    found = derive_configuration(settings).select("configuration", "total_v_cores", "cu_per_second")
    assert [tuple(r) for r in found.collect()] == [
        ("64 vCores", 64, 32),
        ("02 executors 08/08 cores 56g/56g memory", 24, 12),
    ]


def test_every_configuration_row_can_be_derived(spark):
    known = {r.configuration: r for r in schemas.configurations(spark).collect()}
    for label, row in known.items():
        assert row.cu_per_second * 2 == row.total_v_cores, label


def test_run_started_at(spark):
    frame = spark.createDataFrame([("20250105_120000",), ("no date",)], "r string")
    assert [r[0] for r in frame.select(run_started_at(F.col("r"))).collect()] == [START, None]


def test_recorder_appends_its_run_once(spark, store):
    recorder = run_jobs.RunRecorder(
        spark, "single_node", "02 vCores", "w", START, probe=lambda: {"cpu_count": 2}
    )
    with recorder.step("ingest"):
        pass
    with pytest.raises(ValueError), recorder.step("transform"):
        raise ValueError
    for _ in range(2):  # a retry must not double the rows
        recorder.export(store)
    rows = store.read_appended("benchmarks", schemas.RUN_LOG).orderBy("order").collect()
    assert [r.stage_name for r in rows] == ["start", "ingest"]
    assert (rows[0].run_timestamp, rows[0].stage_time, rows[0].cpu_count) == ("20250105_120000", START, 2)


def test_runs_of_one_second_keep_apart(spark, store):
    for configuration in ("02 vCores", "04 vCores", "02_vCores", "02-vCores"):
        recorder = run_jobs.RunRecorder(spark, "single_node", configuration, "w", START)
        recorder.capture("ingest")
        recorder.export(store)
    rows = store.read_appended("benchmarks", schemas.RUN_LOG)
    assert rows.count() == 8 and rows.select("configuration").distinct().count() == 4


def test_recorded_price_run_has_all_stages_in_order(spark, store):
    raw = testdata.price_paid_raw(spark, "/root/testdata/sf0.001")
    price_files.write_price_paid(raw, store.path("raw"))
    recorder = run_jobs.RunRecorder(spark, "single_node", "02 vCores", "prices")
    recorder.capture("setup")
    price_jobs.files_to_summary(spark, store.path("raw"), store, step=recorder.step, force=True)
    rows = recorder.export(store).orderBy("order").collect()
    assert [r.stage_name for r in rows] == schemas.EXECUTION_ORDER
    # Forced steps take time, also those that only build a plan.
    assert all(r.stage_time_delta > 0 for r in rows if r.order > 2)


def test_session_sizes_follow_the_input():
    assert size_settings(1 << 20, 8)["spark.sql.shuffle.partitions"] == "8"
    assert size_settings(1 << 40, 8)["spark.sql.shuffle.partitions"] == "8192"
    assert size_settings(100 << 40, 8)["spark.sql.shuffle.partitions"] == "819200"


def test_log_to_report(spark, log, store):
    run_jobs.write_dimensions(spark, store)
    assert (store.read("stages").count(), store.read("configurations").count()) == (10, 11)
    stored = run_jobs.build_analytics(log, store)
    views.register_run_tables(store)
    assert spark.sql("SELECT count(*) FROM benchmark_analytics JOIN stages USING (stage_name)").first()[0] == 10
    tables = run_jobs.report(stored)
    assert {name: frame.count() for name, frame in tables.items()} == {
        "provisioning": 1,
        "default_environments": 2,
        "fastest": 2,
        "cheapest": 2,
        "elapsed_vs_cost": 2,
        "execution_vs_cost": 2,
        "cumulative": 3,
    }
