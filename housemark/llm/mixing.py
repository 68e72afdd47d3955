"""Mixing sources to target weights by systematic sampling, in DataFrame operations alone.

The mix holds ``share`` times all words. Sources, by code point with null last, share it by
their weights; none gets more than ``most_copies`` times its own words, and what that cuts
off goes to the others by weight until none is above. Each document of a source expects
``target / size of the source`` copies. Its documents are ranked by size and stand so that
sizes rise over the odd ranks and fall over the even ones: neighbours are alike and both
ends are small, so the words taken follow the copies taken. The expected copies are summed
up along that order, one random offset is added for the source, and a document is emitted
once for each whole number that its own part of the sum crosses.

The order is cut into pieces (source, size, slice) of bounded size, so that a source with a
third of all rows is numbered by many tasks: rows are numbered inside pieces, and what
precedes a piece comes from running totals of the piece counts, themselves in ranges.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from housemark.llm.tables import set_aside, words_column
from housemark.operators.ordered import Running, running
from housemark.sources.scratch import stage

# The weights of sources in their order, repeating.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
SEED = "mix-1"
ROWS_PER_PIECE = 1000


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``size``, its words, and ``text_hash``; a null text has no words.

    Columns of these names are replaced, all others stay; an empty table gives an empty one.
    """
    return docs.withColumns(
        {"size": F.size(words_column(F.col(text))).cast("long"), "text_hash": F.xxhash64(text)}
    )


def with_copies(
    docs: DataFrame,
    source: str = "source",
    doc_id: str = "doc_id",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most_copies: int = MOST_COPIES,
    seed: str = SEED,
    rows_per_piece: int = ROWS_PER_PIECE,
) -> DataFrame:
    """``docs``, as ``measured`` gives them, plus ``source_size``, ``target`` and ``copies``.

    Null is a source of its own. A source without words has target 0 and no copies;
    documents without words in other sources take part. Reruns agree: order and offset come
    from hashes of ``seed`` with ids and sources, without an id of all columns, and rows of equal
    id, size and text are interchangeable. Rows of one id, source and size are numbered by one
    task, as are rows without an id that are equal in every column. Columns of these names are replaced; an empty table gives an empty one.
    Reads ``docs`` twice: stage what is costly to compute.
    """
    docs = docs.drop("source_size", "target", "copies")
    owns = {c: f"own{i}" for i, c in enumerate(docs.columns)}
    docs, names = set_aside(docs)
    # Rows without an id come apart by all of their columns.
    number = F.coalesce(
        F.col(owns[doc_id]).cast("string"), F.concat(F.lit(":"), F.xxhash64(*docs.columns))
    )
    key = F.concat_ws(":", F.lit(seed), number)
    rows = docs.withColumns(
        {
            "_source": F.struct(F.col(owns[source]).alias("name")),
            "size": F.col(owns["size"]),
            "_text_hash": F.col(owns["text_hash"]),
        }
    )
    slices = stage(
        rows.groupBy("_source", "size")
        .agg(F.count("*").alias("_rows"))
        .withColumn("_slices", F.ceil(F.col("_rows") / rows_per_piece).cast("int")),
        "slices",
    )
    sizes = slices.groupBy(F.col("_source.name").alias("_name")).agg(
        F.sum(F.col("size") * F.col("_rows")).alias("source_size"),
        F.sum("_rows").alias("_of"),
    )
    targets = stage(source_targets(sizes, weights, share, most_copies, seed), "targets")
    several = stage(slices.where("_slices > 1").select("_source", "size", "_slices"), "several")
    cut = (
        rows.withColumn("_tie", F.md5(key.cast("binary")))
        .join(several, ["_source", "size"], "left")
        .withColumn("_slice", F.floor(_drawn("_tie") * F.coalesce("_slices", F.lit(1))))
    )
    piece = ["_source", "size", "_slice"]
    # Dealt out by piece: else the join's own shuffle would keep the slices of a size together.
    cut = cut.repartition(*piece)
    counts = cut.groupBy(*piece).agg(F.count("*").alias("_rows"))
    summed = running(counts, ["_source"], ["size", "_slice"], Running(total=("_rows", "_upto")))
    before = (
        summed.withColumn("_before", F.col("_upto") - F.col("_rows"))
        .join(targets, F.col("_source.name").eqNullSafe(F.col("_name")))
        .select(*piece, "_before", "_of", "source_size", "target", "_expected", "_offset")
    )
    inside = Window.partitionBy(*piece).orderBy("_tie", "_text_hash")
    numbered = cut.withColumn("_number", F.row_number().over(inside)).join(before, piece)
    rank = F.col("_before") + F.col("_number")
    copies = crossed(rising_and_falling(rank, F.col("_of")), F.col("_expected"), F.col("_offset"))
    return numbered.select(*names, "source_size", "target", copies.alias("copies"))


def _drawn(digest: str | Column) -> Column:
    """A number from 0 to below 1 out of a hexadecimal digest, in the digest's order."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def rising_and_falling(rank: Column, of: Column) -> Column:
    """Place of a rank among ``of`` ranks: 1, 3, 5, ... and back down to 6, 4, 2."""
    half = F.floor(rank / 2)
    return F.when(rank % 2 == 1, half + 1).otherwise(of - half + 1)


def crossed(place: Column, expected: Column, offset: Column) -> Column:
    """Whole numbers in (offset + (place - 1) * expected, offset + place * expected]."""
    return F.floor(offset + place * expected) - F.floor(offset + (place - 1) * expected)


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...], share: float, most_copies: int, seed: str
) -> DataFrame:
    """``sizes`` (_name, source_size, _of) plus ``target``, ``_expected`` copies and ``_offset``.

    Sorted by the words they may hold for each unit of weight, sources reach their limit in
    that order: a source is at its limit if an equal level for it and all after it, from
    what the ones before leave, is at least that. One row for each source.
    """
    place = F.row_number().over(Window.orderBy(F.col("_name").asc_nulls_last()))
    values = F.array(*(F.lit(float(w)) for w in weights))
    weighed = sizes.withColumn("_weight", F.get(values, (place - 1) % len(weights))).withColumn(
        "_limit", most_copies * F.col("source_size").cast("double")
    )
    everything = Window.partitionBy()
    earlier = Window.orderBy(F.col("_limit") / F.col("_weight"), "_name").rowsBetween(
        Window.unboundedPreceding, -1
    )
    left = share * F.sum("source_size").over(everything) - _sum("_limit", earlier)
    sharing = _sum("_weight", everything) - _sum("_weight", earlier)
    level = weighed.withColumn("_level", left / sharing)
    full = F.col("_level") * F.col("_weight") >= F.col("_limit")
    shared = level.withColumn("_shared", F.max(F.when(~full, F.col("_level"))).over(everything))
    target = F.when(full, F.col("_limit")).otherwise(F.col("_shared") * F.col("_weight"))
    key = F.concat_ws(":", F.lit(seed), F.lit("offset"), F.coalesce("_name", F.lit("")))
    return shared.select(
        "_name",
        "_of",
        "source_size",
        target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size"))
        .otherwise(0.0)
        .alias("_expected"),
        _drawn(F.md5(key.cast("binary"))).alias("_offset"),
    )


def _sum(column: str, window) -> Column:
    return F.coalesce(F.sum(column).over(window), F.lit(0.0))
