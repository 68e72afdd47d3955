"""The raw zone: headerless price-paid CSV files, one or more per year."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from housemark.operators.rejects import LINE
from housemark.schemas import PRICE_PAID_RAW

# A doubled quote stands for one quote and an empty field for NULL. Reading needs no
# time format: minutes without seconds are understood, and faster than by a pattern.
CSV = {"header": "false", "nullValue": "", "escape": '"'}
_WRITING = {"quoteAll": "true", "emptyValue": "", "timestampFormat": "yyyy-MM-dd HH:mm"}


def read_price_paid(
    spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """Read every file that ``paths`` names (globs allowed) with the fixed schema.

    Values that do not parse become NULL. Files stay splittable, because no field
    spans lines. ``columns`` is pushed into the scan, so the parser skips the rest.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    raw = spark.read.schema(PRICE_PAID_RAW).options(**CSV).csv(paths)
    return raw.select(*columns) if columns else raw


def read_with_rejects(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """All columns, and for a row with a value that does not parse its line as ``rejected_line``.

    A line with too few or too many fields counts as rejected too. The parser looks at every
    column, so this reads more than a projection of ``read_price_paid``.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    schema = T.StructType([*PRICE_PAID_RAW.fields, T.StructField(LINE, T.StringType())])
    found = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": LINE, "columnPruning": "false"}
    return spark.read.schema(schema).options(**CSV, **found).csv(paths)


def write_lines(texts: DataFrame, path: str, keep: Column | None = None) -> None:
    """Write text columns as quoted lines; ``keep`` is the number of fields to stop after."""
    quoted = [
        F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
        for c in texts.columns
    ]
    fields = F.array(*quoted)
    fields = fields if keep is None else F.slice(fields, F.lit(1), F.coalesce(keep, F.size(fields)))
    texts.select(F.array_join(fields, ",").alias("value")).write.text(path)


def write_price_paid(raw: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Write rows in the layout that :func:`read_price_paid` expects."""
    writer = raw.write.options(**CSV, **_WRITING)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.csv(path)


def union_frames(frames: Sequence[DataFrame]) -> DataFrame:
    """Concatenate frames that were read one by one, matching columns by name."""
    return reduce(DataFrame.unionByName, frames)


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Path and length of every file; contents are pruned from the scan."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length")


def inventory(spark: SparkSession, pattern: str) -> DataFrame:
    """Number of files and their total size in GiB."""
    return list_files(spark, pattern).agg(
        F.count(F.lit(1)).alias("file_count"),
        (F.coalesce(F.sum("length"), F.lit(0)) / F.lit(float(1 << 30))).alias("total_gib"),
    )
