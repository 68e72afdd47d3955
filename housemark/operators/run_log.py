"""The run log: stage records in order, with the time since the stage before."""

from collections.abc import Sequence
from dataclasses import astuple, dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from housemark.functions.runs import (
    as_seconds,
    cluster_cores,
    cluster_label,
    cost_units,
    single_node_label,
    whole_milliseconds,
)
from housemark.operators.ordered import KEY_ROWS, Running, running
from housemark.schemas import ONE_RUN, RUN_LOG, RUN_RECORD


@dataclass(frozen=True)
class StageRecord:
    """One captured stage of one run; times are UTC."""

    platform: str
    configuration: str
    workload_name: str
    run_timestamp: str
    stage_name: str
    stage_time: datetime
    cpu_count: int | None = None
    cpu_usage: float | None = None
    memory: float | None = None
    memory_usage: float | None = None


def records_frame(spark: SparkSession, records: Sequence[StageRecord]) -> DataFrame:
    return spark.createDataFrame([astuple(r) for r in records], RUN_RECORD)


def order_stages(records: DataFrame, bounded: bool = False) -> DataFrame:
    """Number the stages of each run from 1 and measure the seconds between them.

    Deltas are whole milliseconds, NULL for the first stage. Equal times are told
    apart by stage name. ``bounded`` as in :func:`ordered.running`.
    """
    micros = F.unix_micros("stage_time")
    numbered = running(
        records.withColumn("__at", micros),
        ONE_RUN,
        ["stage_time", "stage_name"],
        Running(number="order", previous=("__at", "__before")),
        bounded,
        key_rows=KEY_ROWS,
    )
    delta = whole_milliseconds(F.col("__at") - F.col("__before"))
    return numbered.withColumns(
        {"order": F.col("order").cast("int"), "stage_time_delta": as_seconds(delta)}
    ).select(*RUN_LOG.fieldNames())


def derive_configuration(settings: DataFrame) -> DataFrame:
    """Label, core total and cost units of single-node and cluster settings.

    A row has either ``v_cores`` or the five cluster columns.
    """
    on_cluster = F.col("executor_number").isNotNull()
    label = F.when(
        on_cluster,
        cluster_label(
            F.col("executor_number"),
            F.col("driver_cores"),
            F.col("executor_cores"),
            F.col("driver_memory"),
            F.col("executor_memory"),
        ),
    ).otherwise(single_node_label(F.col("v_cores")))
    cores = F.when(
        on_cluster,
        cluster_cores(F.col("executor_number"), F.col("driver_cores"), F.col("executor_cores")),
    ).otherwise(F.col("v_cores"))
    return settings.withColumns(
        {"configuration": label, "total_v_cores": cores.cast("bigint")}
    ).withColumn("cu_per_second", cost_units(F.col("total_v_cores")))
