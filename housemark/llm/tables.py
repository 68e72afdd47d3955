"""Reading the test tables and the words that several operators share."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What separates words, as characters and as a regular expression.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def set_aside(docs: DataFrame) -> tuple[DataFrame, list[F.Column]]:
    """``docs`` with columns named ``own0``, ``own1`` ..., and the columns under their names.

    An operator that adds columns of its own to the renamed ones meets none of the caller's.
    """
    places = [f"own{i}" for i in range(len(docs.columns))]
    return docs.toDF(*places), [F.col(p).alias(c) for p, c in zip(places, docs.columns)]


def broadcast_if_few(frame: DataFrame, most_rows: int = 10_000) -> DataFrame:
    """``frame``, marked for broadcast if it was counted to have at most ``most_rows`` rows.

    Other frames are left to Spark, which shuffles what is not small. Counts at most
    ``most_rows`` rows and one: give it a written table.
    """
    few = frame.limit(most_rows + 1).count() <= most_rows
    return F.broadcast(frame) if few else frame


def words_column(text) -> F.Column:
    """Array of the words of a text column; none for a null or blank text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WHITE_RUN))


def remainder(doc_id, divisor: int) -> F.Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor
