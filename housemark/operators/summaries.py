"""Joins of the fact with the calendar and summaries of prices."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from housemark.functions.prices import year_month
from housemark.operators.percentiles import exact_percentiles

MONTHLY_KEYS = ["month_tag", "property_type"]


def join_dates(prices: DataFrame, dates: DataFrame) -> DataFrame:
    """Give every price row the month tag of its date; rows without one keep NULL.

    ``dates`` is a stored table, so Spark knows its size: it is broadcast below the
    session's threshold, and joined by shuffle above it.
    """
    calendar = dates.select("date", "month_tag")
    return prices.join(
        calendar, prices["date_of_transfer"] == calendar["date"], "left"
    ).drop("date")


def summarise(frame: DataFrame, keys: Sequence[str], count_nulls: bool = True) -> DataFrame:
    """Transactions, exact median, minimum and maximum of the price per group."""
    count = "row_count" if count_nulls else "value_count"
    result = exact_percentiles(frame, keys, "price", {"median_price": 0.5})
    return result.select(
        *keys,
        F.col(count).alias("number_of_transactions"),
        "median_price",
        F.col("minimum").alias("min_price"),
        F.col("maximum").alias("max_price"),
    )


def ascending(names: Sequence[str]) -> list[Column]:
    return [F.asc_nulls_last(name) for name in names]


def monthly_summary(prices_with_month: DataFrame, count_nulls: bool = True) -> DataFrame:
    return summarise(prices_with_month, MONTHLY_KEYS, count_nulls).orderBy(
        *ascending(MONTHLY_KEYS)
    )


def monthly_summary_approx(prices_with_month: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """One scan and a sketch of fixed size per group; the median is an actual price.

    It is the exact lower median of a group of at most ``accuracy`` prices; beyond that its
    rank is off by at most the part ``1 / accuracy`` of the group.
    """
    return (
        prices_with_month.groupBy(*MONTHLY_KEYS)
        .agg(
            F.count(F.lit(1)).alias("number_of_transactions"),
            F.percentile_approx("price", 0.5, accuracy).alias("median_price"),
            F.min("price").alias("min_price"),
            F.max("price").alias("max_price"),
        )
        .orderBy(*ascending(MONTHLY_KEYS))
    )


def with_month_and_year(raw: DataFrame) -> DataFrame:
    """Raw rows with ``month_number`` and ``year`` of the transfer."""
    return raw.withColumns(
        {"month_number": F.month("date_of_transfer"), "year": F.year("date_of_transfer")}
    )


def monthly_summary_ym(raw: DataFrame) -> DataFrame:
    """Summary of raw rows by year, month and undecoded property type."""
    parts = with_month_and_year(raw)
    return summarise(parts, ["year", "month_number", "property_type"]).orderBy(
        *ascending(["property_type", "year", "month_number"])
    )


def recent_summary(summary: DataFrame, after_year: int = 2015) -> DataFrame:
    """Later years without the kind ``O``, with a sortable label of the month."""
    return summary.where((F.col("year") > after_year) & (F.col("property_type") != "O")).withColumn(
        "year_month", year_month(F.col("year"), F.col("month_number"))
    )


def preview(frame: DataFrame, order: Sequence[str], rows: int = 5) -> DataFrame:
    """The first rows in order; each task keeps only ``rows`` of them."""
    return frame.orderBy(*ascending(order)).limit(rows)


def any_rows(frame: DataFrame, rows: int = 5) -> DataFrame:
    return frame.limit(rows)


def drawn(columns: Sequence[str], seed: int) -> Column:
    """A hexadecimal digest of the row's values and ``seed``, as good as a random number.

    Values are told apart by their lengths, and NULL from any text.
    """
    texts = [F.col(name).cast("string") for name in columns]
    parts = [
        F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in texts
    ]
    return F.md5(F.concat(F.lit(f"{seed}:"), *parts).cast("binary"))


def sample_rows(
    frame: DataFrame, rows: int = 5, seed: int = 0, by: Sequence[str] | None = None
) -> DataFrame:
    """A uniform sample of ``rows`` rows, the same however the rows are dealt out.

    The rows of smallest digest are taken, of which each task keeps ``rows``. ``by`` names
    columns that tell rows apart, else all do; rows that are equal in them share a digest, and
    rows equal in every column are interchangeable.
    """
    names = list(by or frame.columns)
    ties = [F.to_json(F.struct(*frame.columns))] if by else []
    return (
        frame.withColumn("__draw", drawn(names, seed)).orderBy("__draw", *ties).limit(rows).drop("__draw")
    )


def sample_share(
    frame: DataFrame, share: float, seed: int = 0, by: Sequence[str] | None = None
) -> DataFrame:
    """Each row with probability ``share``, decided by its digest alone: no sort, no shuffle.

    Samples of the same seed are nested: a smaller share gives a part of a larger one.
    """
    number = F.conv(F.substring(drawn(list(by or frame.columns), seed), 1, 8), 16, 10).cast("bigint")
    return frame.where(number < int(share * (1 << 32)))
