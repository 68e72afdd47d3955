"""Exact grouped percentiles whose work per task stays bounded.

Spark's ``median`` and ``percentile`` keep all distinct values of a group in the
memory of one task, which fails for a group with a large share of a big table.
Here a group is first cut into cells by magnitude. Counting the cells (one scan,
with partial aggregation) tells which of them hold the wanted ranks, and only the
rows of those cells are then counted by value (a second scan). A cell is
``1 / resolution`` wide relative to its values, but values close to each other, or a
very large group, can still put any number of distinct ones into it: a cell that holds more
than a task can rank is ranked by running totals over ranges (``ordered``).
"""

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from housemark.operators.ordered import KEY_ROWS, Running, running
from housemark.sources.scratch import stage

RESOLUTION = 256
_LAST_CELL = (1 << 63) - 1
_TOTALS = ["__rows", "__n", "__least", "__greatest"]


def _cell(value: Column, resolution: int) -> Column:
    """A number that never falls as ``value`` rises; NaN sorts last, as in Spark."""
    magnitude = F.floor(F.log1p(F.abs(value)) * resolution)
    return (
        F.when(F.isnan(value), F.lit(_LAST_CELL))
        .when(value < 0, -magnitude)
        .otherwise(magnitude)
    )


def _position(probability: float) -> Column:
    """Zero-based fractional rank among the ``__n`` values of the group."""
    return (F.col("__n") - 1) * F.lit(float(probability))


def _holds_rank(probabilities: Sequence[float]) -> Column:
    edges = [edge(_position(p)) for p in probabilities for edge in (F.floor, F.ceil)]
    inside = [(rank >= F.col("__start")) & (rank < F.col("__end")) for rank in edges]
    return reduce(or_, inside)


def _wanted_cells(rows: DataFrame, keys: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Cells that hold a wanted rank, each with the totals of its group."""
    group = W.partitionBy(*keys)
    upto = group.orderBy("__cell").rowsBetween(W.unboundedPreceding, W.currentRow)
    cells = (
        rows.groupBy(*keys, "__cell")
        .agg(
            F.count(F.lit(1)).alias("__rows"),
            F.count("__v").alias("__values"),
            F.min("__v").alias("__low"),
            F.max("__v").alias("__high"),
        )
        .select(
            *keys,
            "__cell",
            (F.sum("__values").over(upto) - F.col("__values")).alias("__start"),
            F.sum("__values").over(upto).alias("__end"),
            F.sum("__rows").over(group).alias("__rows"),
            F.sum("__values").over(group).alias("__n"),
            F.min("__low").over(group).alias("__least"),
            F.max("__high").over(group).alias("__greatest"),
        )
    )
    # A group of NULLs has no rank to hold; its only cell keeps the group alive.
    wanted = cells.where((F.col("__n") == 0) | _holds_rank(probabilities))
    return wanted.withColumn("__held", F.col("__end") - F.col("__start")).drop("__end")


def _ranked_values(
    rows: DataFrame, cells: DataFrame, keys: Sequence[str], probabilities: Sequence[float]
) -> DataFrame:
    """Distinct values at the wanted ranks, as half-open rank ranges, with group totals.

    How many values a cell holds is known: only if one holds more than a task can rank are
    they ranked over ranges.
    """
    few = cells.where(F.col("__held") > KEY_ROWS).isEmpty()
    wanted = cells.withColumnsRenamed({name: f"__of_{name}" for name in [*keys, "__cell"]})
    same_cell = reduce(
        and_,
        [rows[k].eqNullSafe(wanted[f"__of_{k}"]) for k in keys],
        rows["__cell"] == wanted["__of___cell"],
    )
    counted = (
        rows.join(wanted, same_cell)
        .groupBy(*keys, "__cell", "__v", "__start", *_TOTALS)
        .agg(F.count(F.lit(1)).alias("__count"))
    )
    ranked = running(counted, [*keys, "__cell"], ["__v"], Running(total=("__count", "__upto")), few)
    ends = F.col("__start") + F.col("__upto")
    return ranked.select(
        *keys, "__v", *_TOTALS, (ends - F.col("__count")).alias("__from"), ends.alias("__to")
    )


def exact_percentiles(
    frame: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    resolution: int = RESOLUTION,
) -> DataFrame:
    """Interpolated percentiles per group, plus count, minimum and maximum.

    Returns ``keys``, ``row_count``, ``value_count``, ``minimum``, ``maximum`` and one
    column per entry of ``probabilities``. NULL values have no rank, NULL keys form
    a group. ``frame`` is scanned twice: stage it first if it is costly.
    """
    keys, points = list(keys), list(probabilities.values())
    rows = frame.select(*keys, F.col(value).cast("double").alias("__v")).withColumn(
        "__cell", _cell(F.col("__v"), resolution)
    )
    cells = stage(_wanted_cells(rows, keys, points), "cells")

    def value_at(rank: Column) -> Column:
        inside = (rank >= F.col("__from")) & (rank < F.col("__to"))
        return F.max(F.when(inside, F.col("__v")))

    found = (
        _ranked_values(rows, cells, keys, points)
        .groupBy(*keys, *_TOTALS)
        .agg(
            *[value_at(F.floor(_position(p))).alias(f"__low_{i}") for i, p in enumerate(points)],
            *[value_at(F.ceil(_position(p))).alias(f"__high_{i}") for i, p in enumerate(points)],
        )
    )

    def interpolated(i: int, p: float) -> Column:
        share = _position(p) - F.floor(_position(p))
        low, high = F.col(f"__low_{i}"), F.col(f"__high_{i}")
        return F.when(share == 0, low).otherwise(low * (1 - share) + high * share)

    names = ["row_count", "value_count", "minimum", "maximum"]
    totals = [F.col(total).alias(name) for total, name in zip(_TOTALS, names)]
    return found.select(
        *keys,
        *totals,
        *[interpolated(i, p).alias(name) for i, (name, p) in enumerate(probabilities.items())],
    ).union(
        cells.where(F.col("__n") == 0).select(
            *keys, *totals, *[F.lit(None).cast("double").alias(name) for name in probabilities]
        )
    )


def exact_median(frame: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """``keys`` and the interpolated median of ``value`` under ``name``."""
    return exact_percentiles(frame, keys, value, {name: 0.5}).select(*keys, name)
