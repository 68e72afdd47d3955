"""The run log joined with its dimensions, and the report built on it."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from housemark.functions.runs import as_milliseconds, as_seconds, whole_milliseconds
from housemark.operators.ordered import KEY_ROWS, Running, running
from housemark.operators.percentiles import exact_median, exact_percentiles
from housemark.operators.summaries import ascending
from housemark.schemas import (
    CONFIG_KEY,
    DEFAULT_CONFIGURATIONS,
    ONE_RUN,
    REPORTED_CONFIGURATIONS,
    RUN_KEY,
    SETUP_PHASE,
    configurations,
    stages,
)
from housemark.sources.scratch import stage

FIVE_NUMBERS = {
    "minimum_time": 0.0,
    "lower_quartile": 0.25,
    "median_time": 0.5,
    "upper_quartile": 0.75,
    "maximum_time": 1.0,
}


def join_stages(log: DataFrame) -> DataFrame:
    """Add phase and ranks; records of unknown stages are dropped."""
    return log.join(F.broadcast(stages(log.sparkSession)), "stage_name")  # ten literal rows


def join_configurations(log: DataFrame) -> DataFrame:
    """Add scale, cores and cost units; unknown configurations are dropped."""
    # eleven literal rows
    return log.join(F.broadcast(configurations(log.sparkSession)), "configuration")


def cumulative_time(log: DataFrame, bounded: bool = False) -> DataFrame:
    """Seconds from the start of a run to each stage, NULL for the first one."""
    summed = running(
        log.withColumn("__ms", as_milliseconds(F.col("stage_time_delta"))),
        ONE_RUN,
        ["order"],
        Running(total=("__ms", "__total")),
        bounded,
        key_rows=KEY_ROWS,
    )
    return summed.withColumn("cumulative_time", as_seconds(F.col("__total"))).drop(
        "__ms", "__total"
    )


def enrich(log: DataFrame, bounded: bool = False) -> DataFrame:
    """The analytics table: log, both dimensions and cumulative time."""
    return cumulative_time(join_configurations(join_stages(log)), bounded)


def select_configurations(
    analytics: DataFrame, names: Sequence[str] = tuple(REPORTED_CONFIGURATIONS)
) -> DataFrame:
    return analytics.where(F.col("configuration").isin(list(names)))


def distinct_configurations(analytics: DataFrame) -> DataFrame:
    return analytics.select("configuration").distinct().orderBy("configuration")


def without_setup_phase(analytics: DataFrame) -> DataFrame:
    return analytics.where(F.col("phase") != SETUP_PHASE)


def _run_seconds(analytics: DataFrame, name: str) -> DataFrame:
    """Seconds per run, 0 where no stage was measured; exact in any order of rows."""
    total = F.sum(as_milliseconds(F.col("stage_time_delta")))
    return analytics.groupBy(*RUN_KEY).agg(
        as_seconds(F.coalesce(total, F.lit(0))).alias(name)
    )


def elapsed_per_run(analytics: DataFrame) -> DataFrame:
    return _run_seconds(analytics, "total_elapsed_time")


def execution_per_run(analytics: DataFrame) -> DataFrame:
    return _run_seconds(without_setup_phase(analytics), "total_execution_time")


def _median_per_configuration(per_run: DataFrame, value: str, name: str) -> DataFrame:
    return exact_median(stage(per_run.select(*CONFIG_KEY, value), "runs"), CONFIG_KEY, value, name)


def median_elapsed(analytics: DataFrame, name: str = "median_elapsed_time") -> DataFrame:
    return _median_per_configuration(elapsed_per_run(analytics), "total_elapsed_time", name)


def median_execution(analytics: DataFrame, name: str = "median_execution_time") -> DataFrame:
    return _median_per_configuration(execution_per_run(analytics), "total_execution_time", name)


def _with_cost(medians: DataFrame) -> DataFrame:
    return medians.withColumn(
        "total_cu_cost", F.col("median_execution_time") * F.col("cu_per_second")
    )


def unit_cost(analytics: DataFrame) -> DataFrame:
    """Median execution time times the cost units per second."""
    return _with_cost(median_execution(analytics))


def _provisioning(analytics: DataFrame) -> DataFrame:
    setup = analytics.where(F.col("stage_name") == "setup")
    return stage(setup.select("platform", "configuration", "stage_time_delta"), "setup")


def provisioning_median(analytics: DataFrame) -> DataFrame:
    keys = ["platform", "configuration"]
    medians = exact_median(
        _provisioning(analytics), keys, "stage_time_delta", "median_provisioning_time"
    )
    return medians.orderBy(*ascending(["median_provisioning_time", *keys]))


def provisioning_boxplot(analytics: DataFrame) -> DataFrame:
    """Five-number summary of the setup time."""
    keys = ["configuration", "platform"]
    return exact_percentiles(
        _provisioning(analytics), keys, "stage_time_delta", FIVE_NUMBERS
    ).select(*keys, *FIVE_NUMBERS)


def stage_cumulative_median(analytics: DataFrame) -> DataFrame:
    keys = [*CONFIG_KEY, "stage_name", "order"]
    times = stage(without_setup_phase(analytics).select(*keys, "cumulative_time"), "times")
    medians = exact_median(times, keys, "cumulative_time", "median_cumulative_time")
    return medians.orderBy(*ascending([*CONFIG_KEY, "order", "stage_name"]))


def percent_of(value: str, least: Column, name: str) -> Column:
    return F.round(F.col(value) / least * 100, 1).alias(name)


def _lowest(frame: DataFrame, value: str, percentage: str, rows: int = 10) -> DataFrame:
    """Ranked rows with the lowest value, each as percentage of the lowest of all.

    The window has no partitions, but it sees only the ``rows`` rows of the limit,
    whose minimum is the minimum of all rows.
    """
    order = ascending([value, *CONFIG_KEY])
    few = frame.orderBy(*order).limit(rows)
    return few.select(
        F.row_number().over(W.orderBy(*order)).alias("rank"),
        *frame.columns,
        percent_of(value, F.min(value).over(W.partitionBy()), percentage),
    )


def fastest(median_times: DataFrame, rows: int = 10) -> DataFrame:
    return _lowest(median_times, "median_execution_time", "percentage_of_min_time", rows)


def cheapest(costs: DataFrame, rows: int = 10) -> DataFrame:
    return _lowest(costs, "total_cu_cost", "percentage_of_min_cost", rows).select(
        "rank",
        "workload_name",
        "configuration",
        "cu_per_second",
        "median_execution_time",
        "total_cu_cost",
        "percentage_of_min_cost",
    )


def default_environments(
    median_times: DataFrame, names: Sequence[str] = tuple(DEFAULT_CONFIGURATIONS)
) -> DataFrame:
    """Selected configurations, each as percentage of the lowest median among them."""
    chosen = stage(select_configurations(median_times, names), "chosen")
    value = "median_elapsed_time"
    least = chosen.agg(F.min(value)).scalar()
    return chosen.select(
        *chosen.columns, percent_of(value, least, "percentage_of_min_time")
    ).orderBy(*ascending([value, *CONFIG_KEY]))


def medians_per_configuration(analytics: DataFrame) -> DataFrame:
    """Median elapsed and execution time, out of one pass over the log.

    The execution time is NULL where no run left the setup phase.
    """
    ms = as_milliseconds(F.col("stage_time_delta"))
    runs_at_all = F.col("phase") != SETUP_PHASE
    totals = analytics.groupBy(*RUN_KEY).agg(
        F.coalesce(F.sum(ms), F.lit(0)).alias("elapsed"),
        F.when(
            F.count_if(runs_at_all) > 0, F.coalesce(F.sum(F.when(runs_at_all, ms)), F.lit(0))
        ).alias("execution"),
    )
    kinds = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), as_seconds(F.col(kind)).alias("seconds"))
            for kind in ("elapsed", "execution")
        ]
    )
    runs = totals.select(*CONFIG_KEY, F.inline(kinds)).where(F.col("seconds").isNotNull())
    medians = exact_median(stage(runs, "runs"), [*CONFIG_KEY, "kind"], "seconds", "median")

    def of(kind: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col("median")))

    return medians.groupBy(*CONFIG_KEY).agg(
        of("elapsed").alias("median_elapsed_time"), of("execution").alias("median_execution_time")
    )


def elapsed_of(medians: DataFrame) -> DataFrame:
    """The elapsed part of ``medians_per_configuration``."""
    return medians.select(*CONFIG_KEY, "median_elapsed_time")


def execution_of(medians: DataFrame) -> DataFrame:
    """The execution part of ``medians_per_configuration``."""
    known = medians.where(F.col("median_execution_time").isNotNull())
    return known.select(*CONFIG_KEY, "median_execution_time")


def unit_cost_of(medians: DataFrame) -> DataFrame:
    return _with_cost(execution_of(medians))


def elapsed_vs_cost_of(medians: DataFrame) -> DataFrame:
    """Median elapsed time next to the cost, which follows from the execution time."""
    known = medians.where(F.col("median_execution_time").isNotNull())
    return _with_cost(
        known.withColumnRenamed("median_elapsed_time", "median_total_elapsed_time")
    )


def execution_vs_cost_of(medians: DataFrame) -> DataFrame:
    """Median execution time next to the cost that follows from it."""
    execution = F.col("median_execution_time")
    return _with_cost(
        execution_of(medians).select(
            *CONFIG_KEY, execution.alias("median_total_execution_time"), execution
        )
    )


def elapsed_vs_cost(analytics: DataFrame) -> DataFrame:
    return elapsed_vs_cost_of(medians_per_configuration(analytics))


def execution_vs_cost(analytics: DataFrame) -> DataFrame:
    return execution_vs_cost_of(medians_per_configuration(analytics))


def max_memory_by_stage(analytics: DataFrame) -> DataFrame:
    return analytics.groupBy("configuration", "stage_name", "workload_name").agg(
        F.max("memory_usage").alias("max_memory_usage")
    )


def run_detail(analytics: DataFrame) -> DataFrame:
    """The detail table of the report: one row per run, stage and measured values."""
    return analytics.groupBy(
        "run_timestamp",
        "platform",
        "workload_name",
        "configuration",
        "stage_name",
        "stage_time_delta",
        "cpu_count",
    ).agg(
        F.sum("cu_per_second").alias("sum_cu_per_second"),
        F.sum(F.col("memory_usage").cast("decimal(38,9)")).cast("double").alias("sum_memory_usage"),
    )


def run_wall_clock(log: DataFrame) -> DataFrame:
    """Milliseconds between the first and the last stage of each run."""
    at = F.unix_micros("stage_time")
    return log.groupBy(*ONE_RUN).agg(
        whole_milliseconds(F.max(at) - F.min(at)).alias("wall_clock_ms")
    )


QUARTILES = {"lower_quartile": 0.25, "median": 0.5, "upper_quartile": 0.75}


def profile(frame: DataFrame) -> DataFrame:
    """One row per column: counts, spread and quartiles; text extremes for the rest.

    ``frame`` is a stored table: it is scanned once for the simple figures, which
    come out of one wide aggregate, and twice for the quartiles.
    """

    def is_number(field: T.StructField) -> bool:
        return isinstance(field.dataType, T.NumericType)

    def simple(field: T.StructField):
        column = F.col(field.name)
        number = column.cast("double") if is_number(field) else F.lit(None).cast("double")
        text = F.lit(None).cast("string") if is_number(field) else column.cast("string")
        return F.struct(
            F.lit(field.name).alias("column_name"),
            F.count(column).alias("value_count"),
            F.count_if(column.isNull()).alias("null_count"),
            F.round(F.avg(number), 6).alias("mean"),
            F.round(F.stddev_samp(number), 6).alias("std"),
            F.min(text).alias("first_text"),
            F.max(text).alias("last_text"),
        )

    basics = frame.agg(F.array(*[simple(f) for f in frame.schema]).alias("figures")).select(
        F.inline("figures")
    )
    numbers = [
        F.struct(F.lit(f.name).alias("column_name"), F.col(f.name).cast("double").alias("number"))
        for f in frame.schema
        if is_number(f)
    ]
    spread = exact_percentiles(
        frame.select(F.inline(F.array(*numbers))), ["column_name"], "number", QUARTILES
    ).select("column_name", "minimum", *QUARTILES, "maximum")
    # Both sides have one row per column of the frame.
    return basics.join(spread, "column_name", "left")
