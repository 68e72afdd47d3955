"""The tables under their names, for users who write SQL."""

from pyspark.sql import DataFrame

from housemark.operators import star_schema, summaries
from housemark.schemas import DATES, PRICES, RUN_LOG
from housemark.sources.tables import TableStore


def register_files(raw: DataFrame) -> None:
    """Lazy views ``price_paid_raw`` (with month and year) and ``price_paid_data``."""
    summaries.with_month_and_year(raw).createOrReplaceTempView("price_paid_raw")
    star_schema.clean_price_paid(raw).createOrReplaceTempView("price_paid_data")


def register_star_schema(store: TableStore) -> None:
    """Views ``prices``, ``dates`` (with ``month_tag``) and ``locations`` of a store."""
    store.read("prices", PRICES).createOrReplaceTempView("prices")
    star_schema.with_month_tag(store.read("dates", DATES)).createOrReplaceTempView("dates")
    store.read("locations").createOrReplaceTempView("locations")


def register_run_tables(store: TableStore) -> None:
    """Views of the run log's dimensions and of the analytics table of a store."""
    for table in ("stages", "configurations", "benchmark_analytics"):
        store.read(table).createOrReplaceTempView(table)


def register_run_log(store: TableStore) -> None:
    """View ``benchmarks`` of a store's appended run log."""
    store.read_appended("benchmarks", RUN_LOG).createOrReplaceTempView("benchmarks")
