"""Session settings that the jobs are written for."""

import math

from pyspark.sql import SparkSession

# Batch jobs gain more from throughput than from short pauses.
THROUGHPUT_GC = {
    "spark.driver.extraJavaOptions": "-XX:+UseParallelGC",
    "spark.executor.extraJavaOptions": "-XX:+UseParallelGC",
}

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    **THROUGHPUT_GC,
}


_SHUFFLE_BYTES = 128 << 20


def size_settings(input_bytes: int, cores: int) -> dict[str, str]:
    """Partition counts for jobs on ``input_bytes`` of files with ``cores`` task slots.

    Adaptive execution merges small shuffle partitions, but does not split large
    ones, so the number starts from the whole input at about 128 MiB each.
    """
    partitions = max(math.ceil(input_bytes / _SHUFFLE_BYTES), cores)
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(_SHUFFLE_BYTES),
    }


def build_session(
    name: str = "housemark", master: str | None = None, settings: dict[str, str] | None = None
) -> SparkSession:
    """A session with ``SETTINGS``, overridden and extended by ``settings``."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(settings or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
