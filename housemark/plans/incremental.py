"""Enrichment of a growing run log, batch by batch.

The log and the analytics table are both cut into batches by ``batch_id``. A ledger holds the
version of every batch that was enriched, a digest of its files; a refresh reads only batches
that are new or were written again, and replaces only theirs. Which these are is known from a
listing of files alone: no row of an enriched batch is read again.

The ledger is written last, and a batch replaces its own rows, so a refresh that failed at any
point is simply run again. One refresh runs at a time.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from housemark import schemas
from housemark.operators import run_analytics
from housemark.sources.scratch import delete_tree, stage
from housemark.sources.tables import BATCH_COLUMN, TableStore

LEDGER = "enriched_batches"
_PENDING, _GONE = "pending", "gone"
_VERSIONS = T.StructType(
    [T.StructField(BATCH_COLUMN, T.StringType()), T.StructField("version", T.LongType())]
)


def batch_versions(files: DataFrame) -> DataFrame:
    """A digest of the files of each batch, which changes when the batch is written again."""
    digest = F.bit_xor(F.xxhash64("path", "length", "modificationTime"))
    return files.groupBy(BATCH_COLUMN).agg(digest.alias("version"))


def changes(versions: DataFrame, ledger: DataFrame) -> DataFrame:
    """Batches with their ``state``: ``pending`` if new or changed, ``gone`` if no longer there."""
    known = ledger.select(
        F.col(BATCH_COLUMN).alias("known_batch"), F.col("version").alias("known_version")
    )
    both = versions.join(known, versions[BATCH_COLUMN].eqNullSafe(known["known_batch"]), "full")
    state = F.when(F.col("version").isNull(), _GONE).when(
        F.col("known_version").isNull() | (F.col("version") != F.col("known_version")), _PENDING
    )
    batch = F.coalesce(F.col(BATCH_COLUMN), F.col("known_batch"))
    return both.select(batch.alias(BATCH_COLUMN), state.alias("state")).where("state IS NOT NULL")


def pending_log(store: TableStore, log_table: str, changed: DataFrame) -> DataFrame:
    """Records of the pending batches.

    ``changed`` is a written table. Where it is small, Spark broadcasts it and reads no other
    batch's files; where nearly all batches are pending, they are all read anyway.
    """
    pending = changed.where(F.col("state") == _PENDING).select(BATCH_COLUMN)
    return store.read_batches(log_table, schemas.RUN_LOG).join(pending, BATCH_COLUMN, "left_semi")


def refresh_analytics(
    store: TableStore,
    bounded: bool = False,
    log_table: str = "benchmarks",
    table: str = "benchmark_analytics",
) -> DataFrame:
    """Bring the analytics table up to the log and return it, without the batch column.

    All records of a run are in one batch, which has a name. A batch of which the dimensions
    know no record, or that is gone from the log, has none in the table. ``bounded`` as in
    :func:`ordered.running`.
    """
    spark = store.spark
    schema = run_analytics.enrich(spark.createDataFrame([], schemas.RUN_LOG), True).schema
    versions = stage(batch_versions(store.batch_files(log_table)), "versions")
    ledger = store.read(LEDGER, _VERSIONS) if store.is_there(LEDGER) else versions.limit(0)
    changed = stage(changes(versions, ledger), "changed")
    if not changed.isEmpty():
        before = stage(store.batch_files(table).select(BATCH_COLUMN, "path"), "before")
        if not changed.where(F.col("state") == _PENDING).isEmpty():
            log = pending_log(store, log_table, changed)
            enriched = run_analytics.enrich(log, bounded).select(*schema.names, BATCH_COLUMN)
            store.replace_batches(enriched, table, schema)
        # What was not written again has no record left.
        stale = store.batch_files(table).join(changed, BATCH_COLUMN, "left_semi")
        folder = F.regexp_extract("path", "^(.*)/", 1).alias("folder")
        left = stale.join(before, [BATCH_COLUMN, "path"], "left_semi").select(folder).distinct()
        for row in left.toLocalIterator():
            delete_tree(spark, row["folder"], store.root)
        store.overwrite(versions, LEDGER)
    if not store.is_there(table):
        return spark.createDataFrame([], schema)
    return store.read_appended(table, schema)
