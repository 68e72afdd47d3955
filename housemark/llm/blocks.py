"""Cells of any size, dealt out in blocks so that no task gets a whole large cell."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from housemark.sources.scratch import stage


def meet_in_blocks(cells: DataFrame, key: list[str], spread: Column, size: int) -> DataFrame:
    """Rows with ``block``, ``low``, ``high``, so that any two rows of a cell meet once.

    A cell of more than ``size`` rows is split by the hash ``spread`` into blocks of about
    ``size`` rows, and its rows are repeated for every pair of blocks they belong to;
    other cells are one block. Two rows of one block meet where ``low = high``, two rows
    of different blocks where these are ``low`` and ``high``. Cells are counted before the
    shuffle, and the table of large cells has at most one row for ``size`` rows.
    """
    large = stage(
        cells.groupBy(*key)
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > size)
        .select(*key, F.ceil(F.col("n") / size).cast("int").alias("blocks")),
        "large",
    )
    blocks = F.coalesce("blocks", F.lit(1))
    return (
        cells.join(large, key, "left")
        .withColumn("block", F.pmod(spread, blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
        .drop("blocks", "other")
    )
