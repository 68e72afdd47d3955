"""What inner joins with dimensions drop without a word."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from housemark.schemas import ONE_RUN, configurations, stages


def unmatched(
    fact: DataFrame, dimension: DataFrame, key: str, measures: Sequence[Column] = ()
) -> DataFrame:
    """Values of ``key`` that have no row in ``dimension``, each with ``record_count``.

    NULL matches nothing. ``measures`` are further aggregates. The fact is counted by key
    before the join, so only one row for each of its keys is shuffled or held against the
    dimension, however many rows a key has.
    """
    counted = fact.groupBy(key).agg(F.count(F.lit(1)).alias("record_count"), *measures)
    return counted.join(dimension.select(key).distinct(), key, "left_anti")


def unmatched_records(log: DataFrame) -> DataFrame:
    """Stages and configurations of a run log that the analytics table leaves out.

    Columns ``dimension``, ``value``, ``record_count``, ``run_count``, ``first_time`` and
    ``last_time``; a record whose stage and configuration are both unknown is in both.
    """
    measures = [
        F.count_distinct(F.struct(*ONE_RUN)).alias("run_count"),
        F.min("stage_time").alias("first_time"),
        F.max("stage_time").alias("last_time"),
    ]
    spark = log.sparkSession
    audits = []
    for dimension, key in ((stages(spark), "stage_name"), (configurations(spark), "configuration")):
        found = unmatched(log, dimension, key, measures)
        audits.append(found.select(F.lit(key).alias("dimension"), F.col(key).alias("value"), *found.columns[1:]))
    return audits[0].unionByName(audits[1])


def enrichment_balance(log: DataFrame) -> DataFrame:
    """One row: records of the log, those that stay, and why the others do not.

    The four counts add up to the records: ``kept_count``, and records whose stage alone,
    configuration alone or both are unknown.
    """
    known = log.select("stage_name", "configuration")
    for dimension, key in ((stages(log.sparkSession), "stage_name"), (configurations(log.sparkSession), "configuration")):
        names = dimension.select(key).distinct().withColumn(f"known_{key}", F.lit(True))
        known = known.join(F.broadcast(names), key, "left")  # ten and eleven literal rows
    stage, configuration = (F.col(f"known_{x}").isNotNull() for x in ("stage_name", "configuration"))
    return known.agg(
        F.count(F.lit(1)).alias("record_count"),
        F.count_if(stage & configuration).alias("kept_count"),
        F.count_if(~stage & configuration).alias("unknown_stage_count"),
        F.count_if(stage & ~configuration).alias("unknown_configuration_count"),
        F.count_if(~stage & ~configuration).alias("unknown_both_count"),
    )
