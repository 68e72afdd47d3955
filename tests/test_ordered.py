"""Windows in ranges against plain ones."""

import random

import pytest
from pyspark.sql import functions as F

from housemark.operators.ordered import Running, in_ranges, running

WANT = Running(number="n", previous=("v", "p"), total=("v", "t"))


@pytest.fixture(scope="module")
def events(spark):
    draw = random.Random(3)
    rows = []
    for i in range(3000):
        user = draw.choice(["hot", "hot", "warm", "a", "b", None])
        rows.append((i, user, draw.randrange(400), draw.choice([None, 1, 5, 9])))
    rows += [(9000 + i, "same time", 7, i) for i in range(40)]
    return spark.createDataFrame(rows, "id int, user string, at int, v int").cache()


def computed(events, ranges=None, want=WANT, bounded=False):
    frame = running(events, ["user"], ["at", "id"], want, bounded, ranges)
    return sorted(map(tuple, frame.collect()), key=lambda r: r[0])


@pytest.mark.parametrize("ranges", [None, 1, 2, 9, 150])
def test_ranges_change_nothing(events, ranges):
    assert computed(events, ranges) == computed(events, bounded=True)


@pytest.mark.parametrize(
    "want", [Running(number="n"), Running(previous=("v", "p")), Running(total=("v", "t"))]
)
def test_each_alone(events, want):
    assert computed(events, 30, want) == computed(events, want=want, bounded=True)


@pytest.mark.parametrize("rows", [10, 1_000_000])
def test_counted_keys_change_nothing(events, rows):
    frame = running(events, ["user"], ["at"], WANT, key_rows=rows)
    wanted = running(events, ["user"], ["at"], WANT, ranges=7)
    assert sorted(map(str, frame.collect())) == sorted(map(str, wanted.collect()))
    in_ranges = "FileScan" in frame._jdf.queryExecution().executedPlan().toString()
    assert in_ranges == (rows == 10)


POSITIONS = {
    "rising": "id",
    "all equal": "7",
    "a burst": "if(id % 100 = 0, id * 1000000, id)",
    "null": "CAST(NULL AS bigint)",
}


@pytest.mark.parametrize("position", POSITIONS)
def test_one_key_with_all_rows_comes_apart(spark, position):
    """The largest range has at most three times the mean."""
    frame = spark.range(40_000).select(F.lit("hot").alias("user"), "id", F.expr(POSITIONS[position]).alias("at"))
    dealt = in_ranges(frame, ["user"], ["at"], 20).groupBy("__range").count()
    assert dealt.agg(F.max("count")).first()[0] <= 3 * 40_000 / 20


def test_ties_are_numbered_and_chained_once(spark):
    frame = spark.range(500).select(F.lit("hot").alias("user"), F.lit(1).alias("at"), "id")
    want = Running(number="n", previous=("id", "p"), total=("id", "t"))
    rows = sorted(running(frame, ["user"], ["at"], want, ranges=12).collect(), key=lambda r: r.n)
    assert [r.n for r in rows] == list(range(1, 501))
    assert [r.p for r in rows] == [None, *(r.id for r in rows[:-1])]
    assert rows[-1].t == sum(range(500))


def test_null_positions_come_first(spark):
    rows = [(i, "hot", None if i % 3 == 0 else i % 11, 1) for i in range(60)]
    events = spark.createDataFrame(rows, "id int, user string, at int, v int")
    assert computed(events, 15) == computed(events, bounded=True)


def test_no_rows(events):
    assert computed(events.where("id < 0"), 5) == []
