"""Samples whose rows do not depend on how the input is dealt out."""

import pytest
from pyspark.sql import functions as F

from housemark.operators import summaries


@pytest.fixture
def frame(spark):
    return spark.range(5000).selectExpr("id AS a", "concat('t', id % 90) AS b", "if(id % 2 = 0, NULL, 1.5) AS c")


def rows(frame):
    return sorted(map(str, frame.collect()))


def test_the_same_rows_after_any_repartition(frame):
    wanted = summaries.sample_rows(frame, 40, seed=3).collect()
    for other in (frame.repartition(13), frame.repartition(3, "b"), frame.coalesce(1), frame.orderBy(F.desc("a"))):
        assert summaries.sample_rows(other, 40, seed=3).collect() == wanted
    assert rows(summaries.sample_rows(frame, 40, seed=4)) != sorted(map(str, wanted))


def test_ties_in_the_key_are_decided_by_the_whole_row(frame):
    wanted = summaries.sample_rows(frame, 30, by=["b"]).collect()
    assert summaries.sample_rows(frame.repartition(11), 30, by=["b"]).collect() == wanted


def test_the_sample_is_uniform(spark):
    counted = [0, 0]
    for seed in range(60):
        for r in summaries.sample_rows(spark.range(200).coalesce(2), 20, seed).collect():
            counted[r.id >= 100] += 1
    assert sum(counted) == 1200 and abs(counted[0] - 600) < 4 * 17


def test_values_do_not_run_together(spark):
    frame = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "abc"), ("", "abc"), ("-", "abc")], "a string, b string")
    assert frame.select(summaries.drawn(["a", "b"], 1).alias("d")).distinct().count() == 5


def test_shares_are_nested_and_need_no_shuffle(frame):
    small, large = (set(rows(summaries.sample_share(frame, share, 9))) for share in (0.1, 0.3))
    assert small < large and abs(len(small) - 500) < 4 * 22 and abs(len(large) - 1500) < 4 * 33
    assert set(rows(summaries.sample_share(frame.repartition(7), 0.1, 9))) == small
    assert "Exchange" not in summaries.sample_share(frame, 0.1)._jdf.queryExecution().executedPlan().toString()
    assert summaries.sample_share(frame, 1.0).count() == 5000 and summaries.sample_share(frame, 0.0).count() == 0


def test_no_rows_and_fewer_rows_than_asked_for(frame):
    assert summaries.sample_rows(frame.limit(0)).collect() == []
    assert summaries.sample_rows(frame.limit(3), 10).count() == 3
