"""What an ingest could not read: rejected lines, and counts by column.

A reader that keeps unreadable values as NULL tells nobody about them. Here the line of every
row with such a value comes out of the same parse (``price_files.read_with_rejects``), and
only these lines are taken apart again, as texts, to see which columns failed.
"""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The line of a row that could not be read as a whole, NULL for all others.
LINE = "rejected_line"
#: Stands for the line itself where its number of fields is wrong.
FIELDS = "number_of_fields"

_ODD = "odd_line"


def with_failures(parsed: DataFrame, schema: T.StructType, options: Mapping[str, str]) -> DataFrame:
    """``parsed`` plus ``failed_columns``, empty for a row that was read as a whole, and ``texts``.

    A column failed if its text is there and its value is not. ``texts`` has the fields of a
    rejected line as they stand. ``schema`` and ``options`` are those of the reader.
    """
    fields = [T.StructField(f.name, T.StringType()) for f in schema]
    layout = T.StructType([*fields, T.StructField(_ODD, T.StringType())])
    line = F.col(LINE)
    texts = F.from_csv(
        line, F.lit(layout.toDDL()), {**options, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _ODD}
    )
    rows = parsed.withColumn("texts", F.when(line.isNotNull(), texts))

    def failed(name: str, condition: Column) -> Column:
        return F.when(condition, F.lit(name))

    tests = [
        failed(name, F.col(f"texts.{name}").isNotNull() & F.col(name).isNull())
        for name in typed_columns(schema)
    ]
    tests.append(failed(FIELDS, F.col(f"texts.{_ODD}").isNotNull()))
    return rows.withColumn("failed_columns", F.array_compact(F.array(*tests)))


def typed_columns(schema: T.StructType) -> list[str]:
    """Columns that a text may fail to become a value of."""
    return [f.name for f in schema if not isinstance(f.dataType, T.StringType)]


def rejected_lines(failures: DataFrame) -> DataFrame:
    """Each rejected line with the columns that failed and its fields as texts."""
    kept = failures.where(F.col(LINE).isNotNull())
    return kept.select(LINE, "failed_columns", F.col("texts").dropFields(_ODD).alias("texts"))


def reject_counts(failures: DataFrame, schema: T.StructType) -> DataFrame:
    """For each typed column: rows, values read and values rejected, in one scan.

    The row ``number_of_fields`` counts the lines that are too short or too long.
    """

    def counts(name: str, values: Column) -> Column:
        return F.struct(
            F.lit(name).alias("column_name"),
            F.count(F.lit(1)).alias("row_count"),
            values.alias("value_count"),
            F.count_if(F.array_contains("failed_columns", name)).alias("reject_count"),
        )

    rows = [counts(name, F.count(name)) for name in typed_columns(schema)]
    whole = F.count_if(~F.array_contains("failed_columns", FIELDS))
    rows.append(counts(FIELDS, whole))
    return failures.agg(F.array(*rows).alias("counts")).select(F.inline("counts"))
