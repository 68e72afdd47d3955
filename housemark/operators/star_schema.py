"""Cleaning of raw rows and the star schema cut from them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from housemark.functions.prices import (
    decode_old_new,
    decode_property_type,
    month_tag,
    postcode_area,
)
from housemark.schemas import CLEAN_COLUMNS, LOCATION_COLUMNS, PRICES


def clean_price_paid(raw: DataFrame, no_match_as_null: bool = False) -> DataFrame:
    """Decode codes, derive the postcode area, keep the date and the nine used columns."""
    return raw.withColumns(
        {
            "property_type": decode_property_type(F.col("property_type")),
            "old_new": decode_old_new(F.col("old_new")),
            "postcode_area": postcode_area(F.col("postcode"), no_match_as_null),
            "date_of_transfer": F.to_date("date_of_transfer"),
        }
    ).select(*CLEAN_COLUMNS)


def prices_fact(clean: DataFrame) -> DataFrame:
    return clean.select(*PRICES.fieldNames())


def prices_fact_by_year(clean: DataFrame) -> DataFrame:
    """The fact with the year of its date, which its files are then cut by."""
    return prices_fact(clean).withColumn("year", F.year("date_of_transfer"))


def locations_dim(clean: DataFrame) -> DataFrame:
    """Distinct county, district and town."""
    return clean.select(*LOCATION_COLUMNS).distinct()


def date_bounds(clean: DataFrame) -> DataFrame:
    """One row: first and last transfer date, both NULL for no rows."""
    return clean.agg(
        F.min("date_of_transfer").alias("min_date"), F.max("date_of_transfer").alias("max_date")
    )


def dates_dim(bounds: DataFrame) -> DataFrame:
    """Every day between the bounds; the bounds stay inside the plan.

    A date column knows about 3.7 million days, so the result has a fixed limit.
    """
    day = F.explode(F.sequence("min_date", "max_date", F.expr("interval 1 day")))
    return bounds.select(day.alias("date")).select(
        "date",
        F.year("date").alias("year"),
        F.month("date").alias("month"),
        F.date_format("date", "MMMM").alias("month_name"),
        F.dayofmonth("date").alias("day"),
        (F.dayofweek("date") - 1).alias("weekday"),  # Sunday is 0
        F.date_format("date", "EEEE").alias("weekday_name"),
        F.dayofyear("date").alias("day_of_year"),
    )


def with_month_tag(dates: DataFrame) -> DataFrame:
    return dates.withColumn("month_tag", month_tag(F.col("date")))


def in_years(frame: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Rows of the years ``first`` to ``last``; of a table cut by year other files stay shut."""
    year = F.col("year")
    kept = frame.where(year >= first) if first is not None else frame
    return kept.where(year <= last) if last is not None else kept


def on_days(prices: DataFrame, days: DataFrame) -> DataFrame:
    """Prices of the days in ``days``, chosen rows of the stored calendar, with its month tag.

    The join is on the year too, so that with a fact cut by year only the files of the chosen
    days' years are opened, whatever the days were chosen by.
    """
    calendar = with_month_tag(days).select(
        F.col("year").alias("of_year"), F.col("date").alias("of_date"), "month_tag"
    )
    same = (prices["year"] == calendar["of_year"]) & (prices["date_of_transfer"] == calendar["of_date"])
    return prices.join(calendar, same).drop("of_year", "of_date")


def without_other(prices: DataFrame) -> DataFrame:
    """Rows of known kinds only; NULL kinds are rejected too. Reaches the file scan."""
    return prices.where(F.col("property_type") != "Other")
