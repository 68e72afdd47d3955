"""End-to-end price jobs: raw files to star schema to monthly summary."""

from collections.abc import Callable, Sequence
from contextlib import AbstractContextManager, ExitStack, nullcontext

from pyspark.sql import Column, DataFrame, SparkSession

from housemark.operators import rejects, star_schema, summaries
from housemark.schemas import DATES, PRICE_PAID_RAW, PRICES, PRICES_BY_YEAR, RAW_COLUMNS_USED
from housemark.sources.price_files import CSV, read_price_paid, read_with_rejects
from housemark.sources.scratch import stage, staged
from housemark.sources.tables import TableStore

# Wraps a named step, for example to time it.
Step = Callable[[str], AbstractContextManager]


def _run(frame: DataFrame, force: bool) -> DataFrame:
    """Compute a lazy frame without keeping it, so that its step shows its cost."""
    if force:
        frame.write.format("noop").mode("overwrite").save()
    return frame


def write_star_schema(
    clean: DataFrame, store: TableStore, step: Step = nullcontext
) -> None:
    """Write ``prices``, ``dates`` and ``locations``. ``clean`` is scanned twice.

    The date bounds come from the stored fact, where they cost one column.
    """
    with step("write_prices"):
        prices = store.overwrite(star_schema.prices_fact(clean), "prices")
    with step("write_dates"):
        store.overwrite(star_schema.dates_dim(star_schema.date_bounds(prices)), "dates", files=1)
    with step("write_locations"):
        store.overwrite(star_schema.locations_dim(clean), "locations")


def write_star_schema_by_year(clean: DataFrame, store: TableStore) -> None:
    """Write ``prices_by_year``, cut by the year of the transfer, and its ``dates``."""
    by_year = star_schema.prices_fact_by_year(clean)
    prices = store.overwrite_by(by_year, "prices_by_year", ["year"])
    store.overwrite(star_schema.dates_dim(star_schema.date_bounds(prices)), "dates", files=1)


def read_prices_by_year(
    store: TableStore, first: int | None = None, last: int | None = None
) -> DataFrame:
    """Prices of known kinds of some years; no other year's files are opened."""
    stored = store.read("prices_by_year", PRICES_BY_YEAR)
    return star_schema.without_other(star_schema.in_years(stored, first, last))


def summarise_years(
    store: TableStore, first: int | None = None, last: int | None = None
) -> DataFrame:
    """Monthly summary of some years out of the fact that is cut by year."""
    dates = star_schema.in_years(store.read("dates", DATES), first, last)
    prices = read_prices_by_year(store, first, last)
    joined = summaries.join_dates(prices, star_schema.with_month_tag(dates))
    return summaries.monthly_summary(joined)


def summarise_days(store: TableStore, chosen: Column) -> DataFrame:
    """Monthly summary of the days that ``chosen``, a condition on the calendar, holds for.

    Spark finds the years of these days when the join runs, and opens only their files.
    """
    days = store.read("dates", DATES).where(chosen)
    return summaries.monthly_summary(star_schema.on_days(read_prices_by_year(store), days))


def summarise_star_schema(
    store: TableStore,
    approximate: bool = False,
    step: Step = nullcontext,
    force: bool = False,
) -> DataFrame:
    """Read the fact and the calendar back, join them and summarise by month."""
    with step("read_prices"):
        prices = _run(star_schema.without_other(store.read("prices", PRICES)), force)
    with step("read_dates"):
        dates = _run(star_schema.with_month_tag(store.read("dates", DATES)), force)
    with step("join_and_summarise"):
        summarise = summaries.monthly_summary_approx if approximate else summaries.monthly_summary
        return _run(summarise(summaries.join_dates(prices, dates)), force)


def files_to_summary(
    spark: SparkSession,
    paths: str | Sequence[str],
    store: TableStore,
    approximate: bool = False,
    step: Step = nullcontext,
    force: bool = False,
) -> DataFrame:
    """Files to monthly summary; the star schema stays in ``store``.

    ``force`` is for timed runs: also the steps that are lazy are computed where
    they stand, at the price of parsing and reading more than once.

    The files are parsed once: the cleaned rows are staged as a columnar table, from
    which the fact and the locations each read only their own columns. Nothing reads
    the full postcode, so it is not staged. The staged rows go once the star schema stands.
    """
    with step("ingest"):
        raw = _run(read_price_paid(spark, paths, RAW_COLUMNS_USED), force)
    with ExitStack() as kept:
        with step("transform"):
            cleaned = star_schema.clean_price_paid(raw).drop("postcode")
            clean = kept.enter_context(staged(cleaned, "clean"))
        write_star_schema(clean, store, step)
    return summarise_star_schema(store, approximate, step, force)


def ingest_with_rejects(
    spark: SparkSession, paths: str | Sequence[str], store: TableStore
) -> DataFrame:
    """Cleaned rows of the files; what could not be read is written to the store.

    ``rejected_lines`` has the lines with the columns that failed, ``reject_counts`` the number
    of values read and rejected by column. The files are parsed once and staged; a rejected
    value is NULL in the cleaned rows.
    """
    parsed = read_with_rejects(spark, paths)
    failures = stage(
        rejects.with_failures(parsed, PRICE_PAID_RAW, CSV).select(
            *RAW_COLUMNS_USED, rejects.LINE, "failed_columns", "texts"
        ),
        "ingested",
    )
    store.overwrite(rejects.rejected_lines(failures), "rejected_lines")
    store.overwrite(rejects.reject_counts(failures, PRICE_PAID_RAW), "reject_counts", files=1)
    return star_schema.clean_price_paid(failures)


def files_to_recent_summary(
    spark: SparkSession,
    paths: str | Sequence[str],
    store: TableStore,
    after_year: int = 2015,
) -> DataFrame:
    """Raw files to a stored summary by year and month; returns its later years."""
    raw = read_price_paid(spark, paths, ["date_of_transfer", "property_type", "price"])
    # The median scans its input twice, and parsing text twice would cost more.
    summary = summaries.monthly_summary_ym(stage(raw, "raw"))
    stored = store.overwrite_by(summary, "monthly_summary", ["year"])
    return summaries.recent_summary(stored, after_year)
