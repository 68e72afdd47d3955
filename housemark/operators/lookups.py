"""Decoding by a dictionary that is a table of any size."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from housemark.sources.scratch import stage

#: Entries up to which a dictionary goes to every task.
MOST_BROADCAST = 100_000
#: Rows of a code beyond which its rows are dealt out to several tasks.
HOT_ROWS = 1_000_000

_CODE, _MEANING, _SALT = "__code", "__meaning", "__salt"


def decode_by_table(
    frame: DataFrame,
    code: str,
    dictionary: DataFrame,
    key: str = "code",
    value: str = "meaning",
    output: str | None = None,
    most_broadcast: int = MOST_BROADCAST,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``frame`` with the meaning of ``code`` in ``output``, else in place of the code.

    A code without an entry, or with a NULL meaning, stays as it is, NULL too. Of several
    entries of a code the smallest meaning counts, so no row is repeated; a column named
    ``output`` is replaced.

    The entries are written and counted. Up to ``most_broadcast`` they are broadcast. Beyond,
    both sides are shuffled, and a code of more than ``hot_rows`` rows, of which there are at
    most the rows of the frame over ``hot_rows``, is salted: its rows are dealt out evenly, but
    for rows that are equal in every column, and its entry is repeated for each share. The frame
    is then scanned twice.
    """
    output = output or code
    entries = dictionary.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(_CODE))
    entries = stage(entries.agg(F.min(value).alias(_MEANING)), "dictionary")
    few = entries.limit(most_broadcast + 1).count() <= most_broadcast
    if few:
        joined = frame.join(F.broadcast(entries), frame[code] == entries[_CODE], "left")
    else:
        joined = _joined_in_shares(frame, code, entries, hot_rows)
    meaning = F.coalesce(_MEANING, F.col(code))
    names = frame.columns if output in frame.columns else [*frame.columns, output]
    return joined.withColumn(output, meaning).select(*names)


def _joined_in_shares(frame: DataFrame, code: str, entries: DataFrame, hot_rows: int) -> DataFrame:
    """Left join on code and salt; codes with few rows have the one salt 0.

    NULL codes and codes without an entry meet nothing wherever they are: they are salted
    like any other, by all of their rows.
    """
    counted = frame.groupBy(F.col(code).alias("__hot")).agg(F.count(F.lit(1)).alias("__rows"))
    shares = F.ceil(F.col("__rows") / hot_rows).cast("int")
    hot = stage(
        counted.where(F.col("__rows") > hot_rows).select("__hot", shares.alias("__shares")), "hot"
    )
    salted = _with_shares(frame, code, hot).withColumn(
        _SALT, F.pmod(F.monotonically_increasing_id(), F.coalesce("__shares", F.lit(1))).cast("int")
    )
    repeated = _with_shares(entries, _CODE, hot).select(
        _CODE,
        _MEANING,
        F.explode(F.sequence(F.lit(0), F.coalesce("__shares", F.lit(1)) - 1)).alias("__share"),
    )
    same = (salted[code] == repeated[_CODE]) & (salted[_SALT] == repeated["__share"])
    return salted.join(repeated.hint("shuffle_merge"), same, "left")


def _with_shares(frame: DataFrame, code: str, hot: DataFrame) -> DataFrame:
    """Spark broadcasts the written table of hot codes as long as its size allows."""
    return frame.join(hot, frame[code].eqNullSafe(hot["__hot"]), "left").drop("__hot")

