"""Decoding by a table, broadcast or in shares."""

import pytest
from pyspark.sql import functions as F

from housemark.operators.lookups import decode_by_table

WAYS = {"broadcast": {}, "shares": {"most_broadcast": 0, "hot_rows": 10}}


@pytest.fixture
def dictionary(spark):
    rows = [("a", "Apple"), ("b", "Pear"), ("b", "Plum"), ("c", None), (None, "Nothing"), ("", "Empty")]
    return spark.createDataFrame(rows, "code string, meaning string")


@pytest.mark.parametrize("way", WAYS)
def test_every_row_stays_and_unknown_codes_pass(spark, dictionary, way):
    codes = ["a"] * 40 + ["b", "c", "d", "", None] + ["z"] * 30 + [None] * 25
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "id int, code string")
    found = decode_by_table(frame, "code", dictionary, **WAYS[way])
    meanings = {"a": "Apple", "b": "Pear", "": "Empty"}
    assert found.columns == ["id", "code"]
    assert sorted(map(tuple, found.collect())) == [(i, meanings.get(c, c)) for i, c in enumerate(codes)]


@pytest.mark.parametrize("way", WAYS)
def test_output_beside_the_code_or_in_place_of_another(spark, dictionary, way):
    frame = spark.createDataFrame([("a", "old")] * 12 + [("q", "old")], "k string, meaning string")
    found = decode_by_table(frame, "k", dictionary, output="meaning", **WAYS[way])
    assert found.groupBy(*found.columns).count().sort("k").collect() == [("a", "Apple", 12), ("q", "q", 1)]
    added = decode_by_table(frame, "k", dictionary, output="name", **WAYS[way])
    assert added.columns == ["k", "meaning", "name"]


@pytest.mark.parametrize("way", WAYS)
def test_no_rows_and_no_entries(spark, dictionary, way):
    frame = spark.createDataFrame([("a",)] * 15, "code string")
    assert decode_by_table(frame.limit(0), "code", dictionary, **WAYS[way]).collect() == []
    none = decode_by_table(frame, "code", dictionary.limit(0), **WAYS[way])
    assert [r.code for r in none.collect()] == ["a"] * 15


def test_large_dictionaries_are_shuffled_and_small_ones_are_not(spark, path):
    spark.range(200).selectExpr("concat('c', id) AS code", "id").write.parquet(path)
    frame = spark.read.parquet(path)
    entries = spark.range(100).selectExpr("concat('c', id) AS code", "concat('m', id) AS meaning")

    def plan(**limits):
        decoded = decode_by_table(frame, "code", entries, **limits)
        return decoded._jdf.queryExecution().executedPlan().toString()

    assert "SortMergeJoin" not in plan()
    assert "SortMergeJoin [code" in plan(most_broadcast=99)


def test_a_hot_code_is_dealt_out_to_many_tasks(spark, path):
    rows = spark.range(6000).selectExpr("if(id % 3 = 0, concat('c', id), 'hot') AS code", "id")
    rows.write.parquet(path)
    entries = spark.range(6000).selectExpr("concat('c', id) AS code", "'m' AS meaning")
    entries = entries.union(spark.createDataFrame([("hot", "H")], "code string, meaning string"))
    for setting in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.coalescePartitions.enabled"):
        spark.conf.set(setting, "false")
    try:
        found = decode_by_table(spark.read.parquet(path), "code", entries, most_broadcast=0, hot_rows=100)
        sizes = found.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in sizes) == 6000
    assert max(r["count"] for r in sizes) < 2 * 6000 / 4
