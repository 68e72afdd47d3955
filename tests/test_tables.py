"""Sinks: overwrite, replace, append, cache and guarded removal."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from housemark.sources import scratch
from housemark.sources.tables import TableStore

SCHEMA = T.StructType([T.StructField("a", T.LongType())])


def values(frame):
    return sorted(r[0] for r in frame.collect())


def test_overwrite_replaces_rows(spark, store):
    store.overwrite(spark.range(5).toDF("a"), "t")
    assert values(store.overwrite(spark.range(2).toDF("a"), "t", files=1)) == [0, 1]


def test_replace_changes_the_schema(spark, store):
    store.overwrite(spark.range(5).toDF("a"), "t")
    store.replace(spark.createDataFrame([("x",)], "b string"), "t")
    assert store.read("t").columns == ["b"]


def test_append_is_repeatable_and_checked(spark, store):
    for batch, rows in (("one", 2), ("two", 3), ("one", 2)):
        store.append(spark.range(rows).toDF("a"), "t", batch, SCHEMA)
    assert values(store.read_appended("t", SCHEMA)) == [0, 0, 1, 1, 2]
    with pytest.raises(ValueError, match="schema"):
        store.append(spark.range(1).toDF("b"), "t", "three", SCHEMA)
    with pytest.raises(ValueError, match="batch"):
        store.append(spark.range(1).toDF("a"), "t", "../x", SCHEMA)


def test_batch_names_stay_text(spark, store):
    store.append(spark.range(1).toDF("a"), "t", "007", SCHEMA)
    assert values(store.read_appended("t", SCHEMA)) == [0]


def test_cache_is_written_once_unless_refreshed(spark, store):
    assert values(store.cached(spark.range(2).toDF("a"), "t")) == [0, 1]
    assert values(store.cached(spark.range(3).toDF("a"), "t")) == [0, 1]
    assert values(store.cached(spark.range(3).toDF("a"), "t", refresh=True)) == [0, 1, 2]


def test_store_is_removed_only_inside_its_root(spark, store):
    store.overwrite(spark.range(1).toDF("a"), "t")
    with pytest.raises(ValueError):
        store.drop_all("/somewhere/else")
    with pytest.raises(ValueError):
        TableStore(spark, f"{store.root}/../x").drop_all(scratch.scratch_root(spark))
    with pytest.raises(ValueError):
        store.drop_all(store.root)
    assert store.drop_all(scratch.scratch_root(spark))
    assert not store.drop_all(scratch.scratch_root(spark))


def test_staged_table_is_a_file_scan(spark):
    frame = scratch.stage(spark.range(3).toDF("a"))
    assert "FileScan" in frame._jdf.queryExecution().executedPlan().toString()
    assert values(frame) == [0, 1, 2]


def test_retried_appends_of_other_files_replace(spark, store):
    other = TableStore(spark, store.path("orc"), "orc")
    for batch, rows in (("one", 2), ("two", 1), ("one", 2)):
        other.append(spark.range(rows).toDF("a"), "t", batch, SCHEMA)
    assert values(other.read_appended("t", SCHEMA)) == [0, 0, 1]


def test_many_batches_in_one_job_replace_their_own_rows(spark, store):
    batch = F.concat(F.lit("b"), F.col("a") % 2)
    store.append_batches(spark.range(4).toDF("a"), "t", batch, SCHEMA)
    store.append_batches(spark.range(6).where("id % 2 = 0").toDF("a"), "t", batch, SCHEMA)
    assert values(store.read_appended("t", SCHEMA)) == [0, 1, 2, 3, 4]


def test_torn_cache_is_written_again(spark, store):
    store.cached(spark.range(4).toDF("a"), "t")
    scratch.delete_tree(spark, f"{store.path('t')}/_SUCCESS", store.root)
    assert values(store.cached(spark.range(3).toDF("a"), "t")) == [0, 1, 2]


def test_staged_rows_go_with_their_block(spark):
    with scratch.staged(spark.range(3).toDF("a"), "gone") as frame:
        path = frame.inputFiles()[0].rsplit("/", 1)[0]
        assert values(frame) == [0, 1, 2] and scratch.is_complete(spark, path)
    assert not scratch.is_complete(spark, path)
