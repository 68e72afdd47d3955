"""What each filter removes, in every order of the filters and for every part of the corpus.

A document fails a set of filters, its mask, and all that an order of the filters does to it
follows from the mask. Documents are therefore counted by part and mask first, with five
filters at most 32 cells a part. Each cell then folds across the array of all orders, which
goes to the tasks as a literal, into one struct of counts for each order and step; the
structs of a part's cells are added element by element.
"""

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from housemark.sources.scratch import stage

#: The filters in the order of their bits.
FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITALS_PERCENT = 2
# The symbols that a text must not hold, and capital letters.
SYMBOLS = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")

_CONTINUING = bytes(range(0x80, 0xC0))
# Slices of a long text that end before white space or with it.
_SLICE = re.compile(rb"(?s).{1,1000000}[^\x20\x09-\x0D]*")
_MARKS = T.StructType(
    [T.StructField("failed", T.IntegerType()), T.StructField("digest", T.BinaryType())]
)


def _failed(text: bytes) -> int:
    """Bits of the filters that look at one text alone: all but the last."""
    n_words, distinct = 0, set()
    for part in _SLICE.finditer(text):
        words = part.group().split()
        n_words += len(words)
        distinct.update(words)
    capitals = len(text) - len(text.translate(None, CAPITALS))
    points = len(text.translate(None, _CONTINUING))
    tests = (
        n_words < LEAST_WORDS,
        100 * len(distinct) < LEAST_DISTINCT_PERCENT * n_words,
        100 * capitals > MOST_CAPITALS_PERCENT * points,
        len(text.translate(None, SYMBOLS)) < len(text),
    )
    return sum(1 << i for i, failed in enumerate(tests) if failed)


def _marked(docs: DataFrame, doc_id: str, part: str, text: str) -> DataFrame:
    """Columns ``doc_id``, ``part``, ``failed`` and ``digest`` of each document."""
    used = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"),
    )

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            failed = pa.array([_failed(x) for x in texts], pa.int32())
            digests = pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), failed, digests],
                ["doc_id", "part", "failed", "digest"],
            )

    return used.mapInArrow(mark, T.StructType([*used.schema.fields[:2], *_MARKS.fields]))


def cells(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    part: str = "source",
    text: str = "text",
) -> DataFrame:
    """Documents counted by ``part`` and ``mask``: ``n``, and of these ``good`` and ``toxic``.

    A null part is the empty string, a null text the empty text. A document fails the last
    filter if a smaller id has an equal text (by its sha256); a null id is never smaller nor
    larger, and has no labels. Repeated rows count each; of several labels of one id any that
    says so counts. Other columns are not read; an empty table has no cells.

    Equal rows are counted before they are shuffled, the first row of a text is found by a join
    on text and id, and rows with a null id take part in no join, so copies of a text, null ids
    and repeated rows may be any share of the table. The join with labels is on the id;
    different texts with one id rely on adaptive execution.
    """
    marked = stage(_marked(docs, doc_id, part, text), "marked")
    counted = marked.groupBy("doc_id", "part", "failed", "digest").agg(F.count("*").alias("n"))
    known = counted.where("doc_id IS NOT NULL")
    first = marked.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    first = first.where("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    of_id = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    )
    copy = F.when(F.col("first").isNull(), 1 << (len(FILTERS) - 1)).otherwise(0)
    known = (
        known.join(first, ["digest", "doc_id"], "left")
        .join(of_id, "doc_id", "left")
        .select("part", F.col("failed").bitwiseOR(copy).alias("mask"), "n", "good", "toxic")
    )
    unknown = counted.where("doc_id IS NULL").select(
        "part", F.col("failed").alias("mask"), "n", F.lit(False).alias("good"), F.lit(False).alias("toxic")
    )
    number = F.col("n")
    return (
        known.unionByName(unknown)
        .groupBy("part", "mask")
        .agg(
            F.sum(number).alias("n"),
            F.sum(F.when(F.col("good"), number).otherwise(0)).alias("good"),
            F.sum(F.when(F.col("toxic"), number).otherwise(0)).alias("toxic"),
        )
    )


def _steps(cell: Column, order: Column) -> Column:
    """Fold of a cell along one order: a struct of counts for each step."""
    zero = F.lit(0).cast("long")

    def step(state: Column, bit: Column) -> Column:
        gone = state["gone"]
        fails = cell["mask"].bitwiseAND(bit) != 0
        removed = fails & ~gone
        counts = {
            "kept": F.when(fails | gone, zero).otherwise(cell["n"]),
            "removed": F.when(removed, cell["n"]).otherwise(zero),
            "redundant": F.when(fails & gone, cell["n"]).otherwise(zero),
            "unique_fails": F.when(cell["mask"] == bit, cell["n"]).otherwise(zero),
            "good_lost": F.when(removed, cell["good"]).otherwise(zero),
            "toxic_lost": F.when(removed, cell["toxic"]).otherwise(zero),
        }
        found = F.struct(*(counts[name].alias(name) for name in COUNTS))
        return F.struct(
            (gone | fails).alias("gone"), F.array_append(state["steps"], found).alias("steps")
        )

    none = F.array().cast(f"array<struct<{','.join(f'{name}:bigint' for name in COUNTS)}>>")
    start = F.struct(F.lit(False).alias("gone"), none.alias("steps"))
    return F.aggregate(order, start, step, lambda state: state["steps"])


def _added(a: Column, b: Column) -> Column:
    return F.struct(*((a[name] + b[name]).alias(name) for name in COUNTS))


def audit(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """For each ``part``, order of the filters and step: what ``cells`` say is kept and lost.

    Every part gives a row for each order and step, also where nothing is removed. A part is
    folded in one task from its cells, of which there are at most two to the number of filters.
    """
    orders = ["".join(x) for x in permutations(filters)]
    bits = F.lit([[1 << filters.index(x) for x in order] for order in orders])
    size = len(filters)
    length = len(orders) * size
    zeros = F.struct(*(F.lit(0).cast("long").alias(name) for name in COUNTS))
    folded = F.aggregate(
        "cells",
        F.array_repeat(zeros, length),
        lambda total, cell: F.zip_with(
            total, F.flatten(F.transform(bits, lambda order: _steps(cell, order))), _added
        ),
    )

    def share(letter: str) -> Column:
        """What the filter removes, over all orders."""
        places = [i * size + order.index(letter) for i, order in enumerate(orders)]
        return F.aggregate(
            F.lit(places),
            F.lit(0).cast("long"),
            lambda total, place: total + F.get("total", place)["removed"],
        )

    names, letters = F.lit(orders), F.lit([filters.index(x) for order in orders for x in order])
    rows = F.transform(
        "total",
        lambda counts, place: F.struct(
            F.get(names, F.floor(place / size).cast("int")).alias("filter_order"),
            (place % size + 1).alias("step"),
            *(counts[name].alias(name) for name in COUNTS),
            F.get("shares", F.get(letters, place)).alias("shapley"),
        ),
    )
    return (
        counted.groupBy("part")
        .agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
        .select("part", folded.alias("total"))
        .select("part", "total", F.array(*map(share, filters)).alias("shares"))
        .select("part", F.inline(rows))
    )
