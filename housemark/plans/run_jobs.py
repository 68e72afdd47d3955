"""End-to-end jobs on the run log: export, enrichment and report."""

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from datetime import datetime, timezone
from functools import cache, reduce
from hashlib import sha256
from operator import and_
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from housemark import schemas
from housemark.operators import run_analytics
from housemark.operators.run_log import StageRecord, order_stages, records_frame
from housemark.sources.scratch import stage, staged
from housemark.sources.tables import BATCH_COLUMN, TableStore

# Batches that exported runs share. Part of a table's layout: a run is looked for in its group.
RUN_GROUPS = 64
# No batch given to ``TableStore.append`` can have such a name.
_GROUP_PREFIX = "runs~"


class RunRecorder:
    """Collects the stages of one run, a handful of records, and appends them."""

    def __init__(
        self,
        spark: SparkSession,
        platform: str,
        configuration: str,
        workload_name: str,
        started: datetime | None = None,
        probe: Callable[[], dict] = dict,
    ):
        started = started or datetime.now(timezone.utc)
        self._spark = spark
        self._probe = probe
        self._run = (platform, configuration, workload_name, f"{started:%Y%m%d_%H%M%S}")
        self.records: list[StageRecord] = []
        self.capture("start", started)

    def capture(self, stage_name: str, at: datetime | None = None) -> None:
        at = at or datetime.now(timezone.utc)
        self.records.append(StageRecord(*self._run, stage_name, at, **self._probe()))

    @contextmanager
    def step(self, stage_name: str) -> Iterator[None]:
        """Capture the stage when its block has ended without an error."""
        yield
        self.capture(stage_name)

    def export(self, store: TableStore, table: str = "benchmarks") -> DataFrame:
        """Order the records and append them as the batch of this run.

        A run that ``export_runs`` wrote is replaced where it is, among the runs of its group.
        """
        records = records_frame(self._spark, self.records)
        log = order_stages(records, bounded=True)
        if _is_in_group(self._run, store, table):
            export_runs(log, store, table)
        else:
            store.append(log, table, batch_name(self._run), schemas.RUN_LOG)
        return log


def batch_name(run: Sequence[str | None]) -> str:
    """A name of its own for each run key: a digest of its parts with their lengths."""
    parts = (f"{-1 if x is None else len(x)}:{x or ''}" for x in run)
    return sha256("".join(parts).encode()).hexdigest()


def batch_of_run() -> Column:
    """``batch_name`` of a row of the run log."""
    parts = []
    for name in schemas.ONE_RUN:
        size = F.coalesce(F.char_length(name), F.lit(-1))
        parts += [size.cast("string"), F.lit(":"), F.coalesce(F.col(name), F.lit(""))]
    return F.sha2(F.concat(*parts), 256)


def group_name(run: Sequence[str | None]) -> str:
    """The batch that an exported run shares with others."""
    return f"{_GROUP_PREFIX}{crc32(batch_name(run).encode()) % RUN_GROUPS}"


def group_of_run() -> Column:
    """``group_name`` of a row of the run log."""
    return F.concat(F.lit(_GROUP_PREFIX), F.crc32(batch_of_run()) % RUN_GROUPS)


def _is_in_group(run: Sequence[str | None], store: TableStore, table: str) -> bool:
    group = store.read_batch(table, group_name(run), schemas.RUN_LOG)
    same = [F.col(name).eqNullSafe(F.lit(part)) for name, part in zip(schemas.ONE_RUN, run)]
    return not group.where(reduce(and_, same)).isEmpty()


def export_runs(log: DataFrame, store: TableStore, table: str = "benchmarks") -> DataFrame:
    """Append an ordered log, each run in place of its earlier rows; returns the table.

    Runs share the batches of ``RUN_GROUPS`` groups, so folders and files do not grow in number
    with the runs. A run that has a batch of its own, from its recorder, stays there. Groups
    that get rows are written again, with the rows that they had of other runs: one export of
    this kind at a time. ``log`` is read twice if the table is there.
    """
    rows = log.withColumn(BATCH_COLUMN, group_of_run())
    if not store.is_there(table):
        store.replace_batches(rows, table, schemas.RUN_LOG)
        return store.read_appended(table, schemas.RUN_LOG)
    name = batch_of_run().alias("__run")
    stored = store.read_batches(table, schemas.RUN_LOG)
    own = stored.where(~F.col(BATCH_COLUMN).startswith(_GROUP_PREFIX)).select(
        F.col(BATCH_COLUMN).alias("__run")
    )
    with (
        staged(rows.select(name, BATCH_COLUMN).distinct(), "runs") as runs,
        staged(runs.join(own.distinct(), "__run", "left_semi").select("__run"), "alone") as alone,
    ):
        shared = runs.join(alone, "__run", "left_anti")
        groups = [r[0] for r in shared.select(BATCH_COLUMN).distinct().collect()]  # RUN_GROUPS at most
        kept = (
            stored.where(F.col(BATCH_COLUMN).isin(groups))
            .withColumn("__run", batch_of_run())
            .join(shared.select("__run"), "__run", "left_anti")
            .drop("__run")
        )
        alone = alone.withColumn("__own", F.col("__run"))
        placed = rows.withColumn("__run", batch_of_run()).join(alone, "__run", "left")
        new = placed.withColumn(BATCH_COLUMN, F.coalesce("__own", BATCH_COLUMN)).select(*rows.columns)
        store.replace_batches(new.unionByName(kept), table, schemas.RUN_LOG)
    return store.read_appended(table, schemas.RUN_LOG)


def write_dimensions(spark: SparkSession, store: TableStore) -> None:
    store.overwrite(schemas.stages(spark), "stages", files=1)
    store.replace(schemas.configurations(spark).coalesce(1), "configurations")


def build_analytics(
    log: DataFrame, store: TableStore, bounded: bool = False
) -> DataFrame:
    """Enrich a log and replace the analytics table with it."""
    return store.replace(run_analytics.enrich(log, bounded), "benchmark_analytics")


def report(
    analytics: DataFrame,
    names: Sequence[str] = tuple(schemas.REPORTED_CONFIGURATIONS),
    tables: Sequence[str] = (
        "provisioning",
        "default_environments",
        "fastest",
        "cheapest",
        "elapsed_vs_cost",
        "execution_vs_cost",
        "cumulative",
    ),
) -> dict[str, DataFrame]:
    """Tables of the report, from the stored analytics table.

    The five tables of medians share one written row for each configuration.
    """
    chosen = run_analytics.select_configurations(analytics, names)

    @cache
    def medians() -> DataFrame:
        return stage(run_analytics.medians_per_configuration(chosen), "medians")

    made = {
        "provisioning": lambda: run_analytics.provisioning_median(chosen),
        "default_environments": lambda: run_analytics.default_environments(
            run_analytics.elapsed_of(medians())
        ),
        "fastest": lambda: run_analytics.fastest(run_analytics.execution_of(medians())),
        "cheapest": lambda: run_analytics.cheapest(run_analytics.unit_cost_of(medians())),
        "elapsed_vs_cost": lambda: run_analytics.elapsed_vs_cost_of(medians()),
        "execution_vs_cost": lambda: run_analytics.execution_vs_cost_of(medians()),
        "cumulative": lambda: run_analytics.stage_cumulative_median(chosen),
    }
    return {table: made[table]() for table in tables}
