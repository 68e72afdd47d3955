"""Row number, previous value and running total within keys of any size.

A plain window puts all rows of a key into one task. Here the rows are first dealt out in
ranges of the keys, the order and a hash of the whole row, so that also a key with a third of
all rows, a burst, or many rows with equal positions come apart; rows that are equal in every
column are all that stay together. Each range of a key is then a window of its own, and what
precedes it in its key is added from a table of range totals. Only keys that span ranges have
rows in that table, at most two for each range. Where the keys are counted first and all have
few rows, a plain window does the same.
"""

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from housemark.sources.scratch import stage


#: Rows of a key that a task can sort and add up as a plain window.
KEY_ROWS = 1_000_000


@dataclass(frozen=True)
class Running:
    """What to compute: ``(source, output)`` pairs, or an output name for the number."""

    number: str | None = None
    previous: tuple[str, str] | None = None
    total: tuple[str, str] | None = None


def running(
    frame: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    want: Running,
    bounded: bool = False,
    ranges: int | None = None,
    key_rows: int | None = None,
) -> DataFrame:
    """Add the columns of ``want`` to ``frame``, computed per key in ``order``.

    The rows are written once, with the number of their range: ranges come from a sample,
    and both uses of them have to agree. ``ranges`` is Spark's number of shuffle partitions
    unless given. ``bounded`` says that the data model bounds the rows of a key, which makes
    this a plain, lazy window. With ``key_rows`` the rows of the keys are counted, and the
    window is a plain one if no key has more: that reads the frame once more, which the sample
    does too, but writes and shuffles only a count for each key. The results are the same.
    """
    keys, order = list(keys), list(order)
    if bounded:
        return _within(frame, keys, order, want)
    if key_rows is not None and not _has_larger_key(frame, keys, key_rows):
        tied = frame.withColumn("__tie", F.xxhash64(*frame.columns))
        return _within(tied, keys, [*order, "__tie"], want).drop("__tie")
    ranged = stage(in_ranges(frame, keys, order, ranges), "ranged")
    local = _within(ranged, [*keys, "__range"], [*order, "__tie"], want)
    carried = _carried(ranged, keys, [*order, "__tie"], want)
    same = [local[k].eqNullSafe(carried[f"__of_{k}"]) for k in keys]
    joined = local.join(
        carried, reduce(and_, same, local["__range"] == carried["__of_range"]), "left"
    )
    made = {}
    if want.number:
        before = F.coalesce(F.col("__rows_before"), F.lit(0))
        made[want.number] = (before + F.col("__place")).cast("bigint")
    if want.previous:
        out = want.previous[1]
        made[out] = F.when(F.col("__place") == 1, F.col("__tail_before")).otherwise(F.col(out))
    if want.total:
        out, before = want.total[1], F.col("__sum_before")
        made[out] = F.when(before.isNull(), F.col(out)).otherwise(
            before + F.coalesce(F.col(out), F.lit(0))
        )
    return joined.withColumns(made).select(*frame.columns, *made)


def _has_larger_key(frame: DataFrame, keys: Sequence[str], rows: int) -> bool:
    counted = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    return not counted.where(F.col("__rows") > rows).isEmpty()


def in_ranges(
    frame: DataFrame, keys: Sequence[str], order: Sequence[str], ranges: int | None = None
) -> DataFrame:
    """``frame`` dealt out by range, with its range as ``__range`` and the hash ``__tie``."""
    tied = frame.withColumn("__tie", F.xxhash64(*frame.columns))
    by = [*keys, *order, "__tie"]
    dealt = tied.repartitionByRange(ranges, *by) if ranges else tied.repartitionByRange(*by)
    return dealt.withColumn("__range", F.spark_partition_id())


def _carried(ranged: DataFrame, keys: Sequence[str], order: Sequence[str], want: Running) -> DataFrame:
    """What each range of a key that spans ranges takes over from those before it."""
    held = [F.count(F.lit(1)).alias("__rows")]
    if want.previous:
        held.append(F.max_by(want.previous[0], F.struct(*order)).alias("__tail"))
    if want.total:
        held.append(F.sum(want.total[0]).alias("__sum"))
    totals = ranged.groupBy(*keys, "__range").agg(*held)
    in_order = W.partitionBy(*keys).orderBy("__range")
    before = in_order.rowsBetween(W.unboundedPreceding, -1)
    taken = [F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__rows_before")]
    if want.previous:
        taken.append(F.lag("__tail").over(in_order).alias("__tail_before"))
    if want.total:
        taken.append(F.sum("__sum").over(before).alias("__sum_before"))
    spanned = F.count(F.lit(1)).over(W.partitionBy(*keys)).alias("__spanned")
    names = [F.col(k).alias(f"__of_{k}") for k in keys]
    return (
        totals.select(*names, F.col("__range").alias("__of_range"), *taken, spanned)
        .where("__spanned > 1")
        .drop("__spanned")
    )


def _within(frame: DataFrame, keys: Sequence[str], order: Sequence[str], want: Running) -> DataFrame:
    """The plain windows; a frame in ranges also gets the place within the range."""
    rows = W.partitionBy(*keys).orderBy(*order)
    made: dict[str, Column] = {}
    if "__range" in keys:
        made["__place"] = F.row_number().over(rows)
    elif want.number:
        made[want.number] = F.row_number().over(rows).cast("bigint")
    if want.previous:
        made[want.previous[1]] = F.lag(want.previous[0]).over(rows)
    if want.total:
        upto = rows.rowsBetween(W.unboundedPreceding, W.currentRow)
        made[want.total[1]] = F.sum(want.total[0]).over(upto)
    return frame.withColumns(made)
