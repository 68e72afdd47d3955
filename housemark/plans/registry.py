"""Every operator as a named query over the test tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from housemark import schemas
from housemark.functions.prices import (
    decode_by_map,
    decode_old_new,
    decode_property_type,
    postcode_area,
)
from housemark.functions.runs import RUN_ID_FORMAT, run_started_at
from housemark.operators import audits, measures, run_analytics, sketches, star_schema, summaries
from housemark.operators.lookups import decode_by_table
from housemark.operators.run_log import derive_configuration, order_stages
from housemark.plans import incremental, price_jobs, run_jobs
from housemark.sources import price_files, testdata
from housemark.sources.scratch import delete_tree, folders, new_path, stage
from housemark.sources.tables import BATCH_COLUMN, TableStore
from housemark.sources.testdata import RECORDS_PER_RUN_ARE_BOUNDED as BOUNDED

Query = Callable[[SparkSession, str], DataFrame]

# The test rows lie before the year that the report starts with.
RECENT_AFTER = 1997

_QUERIES: dict[str, Query] = {}


def _query(function: Query) -> Query:
    _QUERIES[function.__name__.removesuffix("_query")] = function
    return function


def queries() -> dict[str, Query]:
    return {name: _in_utc(function) for name, function in _QUERIES.items()}


def _in_utc(function: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return function(spark, folder)

    return run


def _store(spark: SparkSession) -> TableStore:
    return TableStore(spark, new_path(spark, "store"))


def _raw(spark: SparkSession, folder: str) -> DataFrame:
    return testdata.price_paid_raw(spark, folder)


def _clean(spark: SparkSession, folder: str) -> DataFrame:
    return star_schema.clean_price_paid(_raw(spark, folder))


def _written_fact(spark: SparkSession, folder: str) -> TableStore:
    """A store with the fact and its calendar, which is what the summaries read."""
    store = _store(spark)
    prices = store.overwrite(star_schema.prices_fact(_clean(spark, folder)), "prices")
    store.overwrite(star_schema.dates_dim(star_schema.date_bounds(prices)), "dates", files=1)
    return store


def _prices_with_month(spark: SparkSession, folder: str) -> DataFrame:
    store = _written_fact(spark, folder)
    dates = star_schema.with_month_tag(store.read("dates", schemas.DATES))
    prices = star_schema.without_other(store.read("prices", schemas.PRICES))
    return summaries.join_dates(prices, dates)


def _raw_zone(spark: SparkSession, folder: str, partition_by: str | None = None) -> str:
    """Raw rows as headerless files; returns their folder."""
    raw = _raw(spark, folder)
    if partition_by == "year":
        raw = raw.withColumn("year", F.year("date_of_transfer"))
    path = new_path(spark, "raw")
    price_files.write_price_paid(raw, path, partition_by)
    return path


# Price pipeline -----------------------------------------------------------------


@_query
def csv_ingest(spark, folder):
    return price_files.read_price_paid(spark, _raw_zone(spark, folder))


@_query
def csv_usecols(spark, folder):
    path = _raw_zone(spark, folder)
    return price_files.read_price_paid(spark, path, schemas.RAW_COLUMNS_USED)


@_query
def union_yearly(spark, folder):
    years = folders(spark, _raw_zone(spark, folder, "year"))
    return price_files.union_frames([price_files.read_price_paid(spark, y) for y in years])


@_query
def raw_inventory(spark, folder):
    return price_files.inventory(spark, f"{folder}/*.parquet")


@_query
def raw_preview(spark, folder):
    return summaries.any_rows(summaries.with_month_and_year(_raw(spark, folder)))


@_query
def decode_property_type_query(spark, folder):
    code = F.col("property_type")
    return _raw(spark, folder).select(
        "transaction_unique_identifier",
        code.alias("code"),
        decode_property_type(code).alias("property_type"),
    )


@_query
def decode_old_new_query(spark, folder):
    code = F.col("old_new")
    return _raw(spark, folder).select(
        "transaction_unique_identifier",
        code.alias("code"),
        decode_old_new(code).alias("old_new"),
    )


@_query
def decode_by_map_query(spark, folder):
    return _raw(spark, folder).select(
        "transaction_unique_identifier",
        decode_by_map(F.col("property_type"), schemas.PROPERTY_TYPES).alias("property_type"),
        decode_by_map(F.col("old_new"), schemas.OLD_NEW).alias("old_new"),
    )


def _decoded_lines(spark: SparkSession, folder: str, **limits: int) -> DataFrame:
    """Order lines with the state of their order, a third of them of one code.

    One order in ten is not in the dictionary, and some are in it twice.
    """
    key = F.col("l_orderkey")
    lines = testdata.table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(key % 3 == 0, "O3").when(key % 50 != 1, F.concat(F.lit("O"), key)).alias("code"),
    )
    orders = testdata.table(spark, folder, "orders").where("o_orderkey % 10 <> 2")
    entries = orders.select(
        F.concat(F.lit("O"), "o_orderkey").alias("code"),
        F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("meaning"),
    )
    twice = entries.where("code LIKE '%7'").withColumn("meaning", F.concat(F.lit("~"), "meaning"))
    return decode_by_table(lines, "code", entries.union(twice), output="state", **limits)


@_query
def decode_by_dictionary(spark, folder):
    return _decoded_lines(spark, folder)


@_query
def decode_by_large_dictionary(spark, folder):
    """The same by shuffles, with the hot code in shares, whatever the size of the tables."""
    return _decoded_lines(spark, folder, most_broadcast=0, hot_rows=1000)


@_query
def postcode_area_query(spark, folder):
    return _raw(spark, folder).select(
        "transaction_unique_identifier",
        "postcode",
        postcode_area(F.col("postcode")).alias("postcode_area"),
        postcode_area(F.col("postcode"), no_match_as_null=True).alias("postcode_area_or_null"),
    )


@_query
def clean_price_paid(spark, folder):
    return _clean(spark, folder)


@_query
def prices_fact(spark, folder):
    return star_schema.prices_fact(_clean(spark, folder))


@_query
def prices_readback(spark, folder):
    stored = _store(spark).overwrite(star_schema.prices_fact(_clean(spark, folder)), "prices")
    return star_schema.without_other(stored)


@_query
def date_bounds(spark, folder):
    return star_schema.date_bounds(_clean(spark, folder))


@_query
def dates_dim(spark, folder):
    return star_schema.dates_dim(star_schema.date_bounds(_clean(spark, folder)))


@_query
def dates_readback(spark, folder):
    dates = star_schema.dates_dim(star_schema.date_bounds(_clean(spark, folder)))
    return star_schema.with_month_tag(_store(spark).overwrite(dates, "dates", files=1))


@_query
def locations_dim(spark, folder):
    return star_schema.locations_dim(_clean(spark, folder))


@_query
def locations_readback(spark, folder):
    return _store(spark).overwrite(star_schema.locations_dim(_clean(spark, folder)), "locations")


@_query
def price_dates_join(spark, folder):
    return _prices_with_month(spark, folder)


@_query
def monthly_summary(spark, folder):
    return price_jobs.summarise_star_schema(_written_fact(spark, folder))


@_query
def monthly_summary_approx(spark, folder):
    return price_jobs.summarise_star_schema(_written_fact(spark, folder), approximate=True)


@_query
def monthly_nonnull(spark, folder):
    return summaries.monthly_summary(_prices_with_month(spark, folder), count_nulls=False)


def _written_by_year(spark: SparkSession, folder: str) -> TableStore:
    store = _store(spark)
    price_jobs.write_star_schema_by_year(_clean(spark, folder), store)
    return store


@_query
def prices_of_years(spark, folder):
    return price_jobs.read_prices_by_year(_written_by_year(spark, folder), RECENT_AFTER + 1, 1999)


@_query
def monthly_summary_of_years(spark, folder):
    return price_jobs.summarise_years(_written_by_year(spark, folder), RECENT_AFTER + 1, 1999)


@_query
def weekend_summary(spark, folder):
    """Weekends of two winters, chosen in the calendar."""
    winter = F.col("month").isin(12, 1, 2) & F.col("year").between(1996, 1997)
    weekend = F.col("weekday").isin(0, 6)
    return price_jobs.summarise_days(_written_by_year(spark, folder), winter & weekend)


@_query
def yearly_prices_sketched(spark, folder):
    """Years out of the stored sketches of months; prices are not read again."""
    months = sketches.price_sketches(_prices_with_month(spark, folder))
    stored = _store(spark).overwrite(months, "price_sketches")
    return sketches.merged_prices(sketches.with_year(stored), ["year", "property_type"])


@_query
def summary_preview(spark, folder):
    return summaries.preview(monthly_summary(spark, folder), summaries.MONTHLY_KEYS)


@_query
def monthly_summary_ym(spark, folder):
    raw = _raw(spark, folder).select("date_of_transfer", "property_type", "price")
    return summaries.monthly_summary_ym(stage(raw, "raw"))


@_query
def recent_summary(spark, folder):
    return summaries.recent_summary(monthly_summary_ym(spark, folder), RECENT_AFTER)


def _ingested(spark: SparkSession, folder: str) -> tuple[TableStore, DataFrame]:
    """A store with what an ingest of partly unreadable lines rejected, and the cleaned rows."""
    path, store = new_path(spark, "raw"), _store(spark)
    texts = testdata.price_paid_texts(spark, folder)
    price_files.write_lines(texts, path, testdata.fields_of_line())
    return store, price_jobs.ingest_with_rejects(spark, path, store)


@_query
def ingest_rejects(spark, folder):
    return _ingested(spark, folder)[0].read("reject_counts")


@_query
def ingest_quarantine(spark, folder):
    lines = _ingested(spark, folder)[0].read("rejected_lines")
    return lines.select(
        "texts.transaction_unique_identifier",
        F.array_join("failed_columns", ",").alias("failed_columns"),
        F.col("texts.price").alias("price_text"),
        F.col("texts.date_of_transfer").alias("date_text"),
        F.col("texts.county").alias("county_text"),
    )


@_query
def ingest_accepted(spark, folder):
    """Cleaned rows of the same ingest: rejected values are NULL, all rows stay."""
    return _ingested(spark, folder)[1]


@_query
def files_to_summary(spark, folder):
    return price_jobs.files_to_summary(spark, _raw_zone(spark, folder), _store(spark))


@_query
def files_to_recent_summary(spark, folder):
    raw_zone = _raw_zone(spark, folder)
    return price_jobs.files_to_recent_summary(spark, raw_zone, _store(spark), RECENT_AFTER)


# Run log ------------------------------------------------------------------------


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return order_stages(testdata.run_records(spark, folder), BOUNDED)


def _analytics(spark: SparkSession, folder: str) -> DataFrame:
    return run_analytics.enrich(_log(spark, folder), BOUNDED)


def _reported(spark: SparkSession, folder: str) -> DataFrame:
    return run_analytics.select_configurations(_analytics(spark, folder))


@_query
def run_log(spark, folder):
    return testdata.run_records(spark, folder)


@_query
def stage_order_delta(spark, folder):
    return order_stages(testdata.run_records(spark, folder))


@_query
def run_log_append(spark, folder):
    store, log = _store(spark), stage(_log(spark, folder), "log")
    on_cluster = F.col("platform").eqNullSafe("cluster")
    for batch, rows in (("cluster", log.where(on_cluster)), ("single_node", log.where(~on_cluster))):
        store.append(rows, "benchmarks", batch, schemas.RUN_LOG)
    return store.read_appended("benchmarks", schemas.RUN_LOG)


@_query
def run_log_export(spark, folder):
    """Each run is a batch; the second export of them replaces the first."""
    store, log = _store(spark), stage(_log(spark, folder), "log")
    run_jobs.export_runs(log, store)
    return run_jobs.export_runs(log, store)


@_query
def run_log_readback(spark, folder):
    return _store(spark).overwrite(_log(spark, folder), "benchmarks")


@_query
def run_started_at_query(spark, folder):
    """Start of each event's run identifier, made from its time by the same format."""
    at = F.col("ts").cast("timestamp")
    return testdata.table(spark, folder, "events").select(
        "event_id", F.date_format(at, RUN_ID_FORMAT).alias("run_timestamp")
    ).withColumn("started_at", run_started_at(F.col("run_timestamp")))


@_query
def configuration_derivation(spark, folder):
    events = testdata.event_settings(spark, folder)
    return derive_configuration(events).groupBy(
        "configuration", "total_v_cores", "cu_per_second"
    ).agg(F.count(F.lit(1)).alias("event_count"))


def _with_log_counts(dimension: DataFrame, log: DataFrame, key: str) -> DataFrame:
    counts = log.groupBy(key).agg(F.count(F.lit(1)).alias("record_count"))
    return dimension.join(counts, key, "left").withColumn(
        "record_count", F.coalesce("record_count", F.lit(0))
    )


@_query
def stages_dim(spark, folder):
    stored = _store(spark).overwrite(schemas.stages(spark), "stages", files=1)
    return _with_log_counts(stored, testdata.run_records(spark, folder), "stage_name")


@_query
def configurations_dim(spark, folder):
    stored = _store(spark).replace(schemas.configurations(spark), "configurations")
    return _with_log_counts(stored, testdata.run_records(spark, folder), "configuration")


@_query
def run_wall_clock(spark, folder):
    return run_analytics.run_wall_clock(testdata.run_records(spark, folder))


def _round_quartiles(frame: DataFrame) -> DataFrame:
    """Interpolated quartiles differ between engines in the last bit of a double."""
    return frame.withColumns(
        {name: F.round(name, 6) for name in ("lower_quartile", "upper_quartile")}
    )


@_query
def profile_run_log(spark, folder):
    return _round_quartiles(run_analytics.profile(run_log_readback(spark, folder)))


# Audits -------------------------------------------------------------------------


def _log_with_odd_stages(spark: SparkSession, folder: str) -> DataFrame:
    """The log with some records of a stage that has no row, and some of none."""
    k = F.col("cpu_usage").cast("int")
    name = F.when(k % 10 == 7, "teardown").when(k % 10 != 3, F.col("stage_name"))
    return _log(spark, folder).withColumn("stage_name", name)


@_query
def unmatched_configurations(spark, folder):
    return audits.unmatched_records(_log_with_odd_stages(spark, folder))


@_query
def enrichment_balance(spark, folder):
    return audits.enrichment_balance(_log_with_odd_stages(spark, folder))


@_query
def unmatched_customers(spark, folder):
    """Customers of the order table that the customer table lacks, by a join of two tables."""
    orders = testdata.table(spark, folder, "orders").withColumnRenamed("o_custkey", "c_custkey")
    customers = testdata.table(spark, folder, "customer").where(F.col("c_mktsegment") != "BUILDING")
    prices = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total_price")
    return audits.unmatched(orders, customers, "c_custkey", [prices])


# Enrichment ---------------------------------------------------------------------


@_query
def log_with_stages(spark, folder):
    return run_analytics.join_stages(_log(spark, folder))


@_query
def log_with_configurations(spark, folder):
    return run_analytics.join_configurations(_log(spark, folder))


@_query
def cumulative_time(spark, folder):
    return _analytics(spark, folder)


@_query
def analytics_readback(spark, folder):
    """The enriched table takes the place, and the schema, of a plain log."""
    store, log = _store(spark), _log(spark, folder)
    store.overwrite(log, "benchmark_analytics")
    return run_jobs.build_analytics(log, store, BOUNDED)


@_query
def analytics_incremental(spark, folder):
    """Three arrivals of the log, one batch with lost values written again, one that goes.

    Each arrival is enriched by itself; the table must be that of the whole log.
    """
    store, log = _store(spark), stage(_log(spark, folder), "log")
    number = F.pmod(F.xxhash64(*schemas.ONE_RUN), F.lit(12))
    batch = F.concat(F.lit("b"), number)
    torn = log.withColumn("stage_time_delta", F.lit(None).cast("double"))
    extra = log.where(number == 3).withColumn("workload_name", F.lit("withdrawn"))
    arrivals = (
        (log.where(number < 4), batch),
        (torn.where(number.between(4, 7)), batch),
        (log.where(number > 7), batch),
        (extra, F.lit("withdrawn")),
        (log.where(number.between(4, 7)), batch),
    )
    for rows, name in arrivals:
        store.append_batches(rows, "benchmarks", name, schemas.RUN_LOG)
        incremental.refresh_analytics(store, BOUNDED)
    delete_tree(spark, f"{store.path('benchmarks')}/{BATCH_COLUMN}=withdrawn", store.root)
    return incremental.refresh_analytics(store, BOUNDED)


@_query
def analytics_cache(spark, folder):
    """The second write finds the cached table and leaves it as it is."""
    store, analytics = _store(spark), _analytics(spark, folder)
    store.cached(analytics, "benchmarks")
    return store.cached(analytics.where(F.lit(False)), "benchmarks")


# Report -------------------------------------------------------------------------


@_query
def distinct_configurations(spark, folder):
    return run_analytics.distinct_configurations(_analytics(spark, folder))


@_query
def selected_configurations(spark, folder):
    return _reported(spark, folder)


# What tells records of the log apart.
_RECORD = [*schemas.ONE_RUN, "stage_name"]


@_query
def sample_rows(spark, folder):
    return summaries.sample_rows(_reported(spark, folder), seed=7, by=_RECORD)


@_query
def sample_share(spark, folder):
    return summaries.sample_share(_reported(spark, folder), 0.05, seed=7, by=_RECORD)


@_query
def elapsed_per_run(spark, folder):
    return run_analytics.elapsed_per_run(_reported(spark, folder))


@_query
def execution_per_run(spark, folder):
    return run_analytics.execution_per_run(_reported(spark, folder))


@_query
def median_elapsed(spark, folder):
    return run_analytics.median_elapsed(_reported(spark, folder))


@_query
def median_execution(spark, folder):
    return run_analytics.median_execution(_reported(spark, folder))


@_query
def unit_cost(spark, folder):
    return run_analytics.unit_cost(_reported(spark, folder))


@_query
def default_environments(spark, folder):
    return run_analytics.default_environments(median_elapsed(spark, folder))


@_query
def fastest_10(spark, folder):
    return run_analytics.fastest(median_execution(spark, folder))


@_query
def cheapest_10(spark, folder):
    return run_analytics.cheapest(unit_cost(spark, folder))


@_query
def elapsed_vs_cost(spark, folder):
    return run_analytics.elapsed_vs_cost(_reported(spark, folder))


@_query
def execution_vs_cost(spark, folder):
    return run_analytics.execution_vs_cost(_reported(spark, folder))


@_query
def provisioning_median(spark, folder):
    return run_analytics.provisioning_median(_reported(spark, folder))


@_query
def provisioning_boxplot(spark, folder):
    return _round_quartiles(run_analytics.provisioning_boxplot(_reported(spark, folder)))


@_query
def stage_cumulative_median(spark, folder):
    return run_analytics.stage_cumulative_median(_reported(spark, folder))


def _report_query(name: str) -> None:
    """A table of the report, built from the stored analytics table."""

    def query(spark, folder):
        stored = analytics_readback(spark, folder)
        return run_jobs.report(stored, tables=[name])[name]

    _QUERIES[f"report_{name}"] = query


for _name in (
    "provisioning",
    "default_environments",
    "fastest",
    "cheapest",
    "elapsed_vs_cost",
    "execution_vs_cost",
    "cumulative",
):
    _report_query(_name)


@_query
def max_memory_by_stage(spark, folder):
    return run_analytics.max_memory_by_stage(_analytics(spark, folder))


@_query
def run_detail(spark, folder):
    return run_analytics.run_detail(_analytics(spark, folder))


@_query
def total_time(spark, folder):
    return measures.total_time(_analytics(spark, folder))


@_query
def average_time(spark, folder):
    return measures.average_time(_analytics(spark, folder))


@_query
def median_time(spark, folder):
    return measures.median_time(_analytics(spark, folder))


@_query
def run_count(spark, folder):
    return measures.run_count(_analytics(spark, folder))


def _stored_run_sketches(spark: SparkSession, folder: str) -> DataFrame:
    days = sketches.run_sketches(_analytics(spark, folder))
    return _store(spark).overwrite(days, "run_sketches")


@_query
def run_count_sketched(spark, folder):
    """Runs of two weeks by platform and workload, out of the sketches of days."""
    weeks = F.col("day").between(F.lit("2024-01-08").cast("date"), F.lit("2024-01-21").cast("date"))
    found = _stored_run_sketches(spark, folder).where(weeks)
    return sketches.merged_runs(found, ["platform", "workload_name"])


@_query
def run_count_by_scope(spark, folder):
    """The same sketches under three other groupings: configuration, platform, and all."""
    stored = _stored_run_sketches(spark, folder)
    scopes = {"configuration": ["configuration"], "platform": ["platform"], "all": []}
    parts = [
        sketches.merged_runs(stored, by).select(
            F.lit(scope).alias("scope"),
            F.col(by[0]).alias("value") if by else F.lit(None).cast("string").alias("value"),
            "record_count",
            "run_count",
        )
        for scope, by in scopes.items()
    ]
    return price_files.union_frames(parts)


@_query
def median_stage_time(spark, folder):
    return measures.median_stage_time(_analytics(spark, folder))


@_query
def average_cost(spark, folder):
    return measures.average_cost(_analytics(spark, folder))


@_query
def median_cost(spark, folder):
    return measures.median_cost(_analytics(spark, folder))


@_query
def measures_by_context(spark, folder):
    return measures.measures_by_context(_analytics(spark, folder))


@_query
def time_cost_scatter(spark, folder):
    return measures.time_cost_scatter(_analytics(spark, folder))
