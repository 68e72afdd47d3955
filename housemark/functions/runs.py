"""Column expressions for run identifiers, durations and configurations."""

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN_ID_FORMAT = "yyyyMMdd_HHmmss"


def run_started_at(run_id: Column) -> Column:
    """Start of a run from its identifier; NULL where it is no timestamp."""
    return F.try_to_timestamp(run_id, F.lit(RUN_ID_FORMAT))


def whole_milliseconds(micros: Column) -> Column:
    """Non-negative microseconds to milliseconds, half up, without floating point."""
    return F.call_function("div", micros + 500, F.lit(1000))


def as_seconds(milliseconds: Column) -> Column:
    return milliseconds / F.lit(1000.0)


def as_milliseconds(seconds: Column) -> Column:
    """Seconds with three decimals back to whole milliseconds, so that sums are exact."""
    return F.round(seconds * 1000).cast("bigint")


def single_node_label(v_cores: Column) -> Column:
    return F.format_string("%02d vCores", v_cores)


def cluster_label(
    executors: Column,
    driver_cores: Column,
    executor_cores: Column,
    driver_memory: Column,
    executor_memory: Column,
) -> Column:
    return F.format_string(
        "%02d executors %02d/%02d cores %s/%s memory",
        executors,
        driver_cores,
        executor_cores,
        driver_memory,
        executor_memory,
    )


def cluster_cores(executors: Column, driver_cores: Column, executor_cores: Column) -> Column:
    return driver_cores + executors * executor_cores


def cost_units(total_v_cores: Column) -> Column:
    """Cost units per second: half a unit per core; an odd number of cores is an error."""
    odd = F.raise_error(F.concat(F.lit("odd number of cores: "), total_v_cores.cast("string")))
    whole = F.call_function("div", total_v_cores, F.lit(2))
    return F.when(total_v_cores % 2 != 0, odd.cast("bigint")).otherwise(whole)
