"""Summaries that are stored once and merged under any grouping, without a second scan.

A quantile sketch (KLL) of the prices is kept for each month and kind, a distinct-count sketch
(HLL) of the runs for each day and configuration. Merging them costs a row for each stored
sketch, whatever the number of prices or records; counts, extremes and sums merge exactly.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from housemark.operators.summaries import MONTHLY_KEYS, ascending
from housemark.schemas import CONFIG_KEY

#: Size of a quantile sketch: up to about so many values are kept as they are.
QUANTILE_K = 2048
#: Rank error that a sketch of that size keeps within, with 99 of 100 chances, as part of all.
RANK_ERROR = 0.0014
#: Logarithm of the number of registers of a distinct count: 0.8 % standard error.
DISTINCT_LG_K = 14

QUARTILES = {"lower_quartile": 0.25, "median_price": 0.5, "upper_quartile": 0.75}


def price_sketches(
    prices_with_month: DataFrame, keys: Sequence[str] = MONTHLY_KEYS, k: int = QUANTILE_K
) -> DataFrame:
    """Count, extremes and a quantile sketch of the price for each group.

    A group without a price has a NULL sketch, and NaN prices are left out of it: they have
    no rank.
    """
    known = F.when(~F.isnan("price"), F.col("price"))
    return prices_with_month.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count(known).alias("value_count"),
        F.min(known).alias("min_price"),
        F.max(known).alias("max_price"),
        F.when(F.count(known) > 0, F.kll_sketch_agg_double(known, k)).alias("price_sketch"),
    )


def merged_prices(
    sketches: DataFrame, keys: Sequence[str], probabilities: Mapping[str, float] = QUARTILES
) -> DataFrame:
    """Stored sketches merged by ``keys``, with the price at each of ``probabilities``.

    Up to as many values as a sketch keeps, the price is the lower of those around the rank;
    beyond, its rank is off by ``RANK_ERROR`` of the group at most, save for unlikely cases.
    """
    merged = sketches.groupBy(*keys).agg(
        F.sum("row_count").alias("number_of_transactions"),
        F.min("min_price").alias("min_price"),
        F.max("max_price").alias("max_price"),
        F.sum("value_count").alias("__values"),
        F.kll_merge_agg_double("price_sketch").alias("__merged"),
    )
    prices = {
        name: F.when(F.col("__values") > 0, F.kll_sketch_get_quantile_double("__merged", F.lit(p)))
        for name, p in probabilities.items()
    }
    names = [*keys, "number_of_transactions", *prices, "min_price", "max_price"]
    found = merged.withColumns(prices).select(*names)
    return found.orderBy(*ascending(keys)) if keys else found


def with_year(sketches: DataFrame) -> DataFrame:
    """The year of the month tag, as a column to merge by."""
    return sketches.withColumn("year", F.substring("month_tag", 1, 4).try_cast("int"))


def run_sketches(analytics: DataFrame, lg_k: int = DISTINCT_LG_K) -> DataFrame:
    """Records and a distinct-count sketch of the runs for each day and configuration."""
    return analytics.groupBy(F.to_date("stage_time").alias("day"), *CONFIG_KEY).agg(
        F.count(F.lit(1)).alias("record_count"),
        F.hll_sketch_agg("run_timestamp", lg_k).alias("run_sketch"),
    )


def merged_runs(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Records and estimated distinct runs of the chosen sketches, by ``by``.

    A run that lies on two days counts once. Filter the sketches first; nothing is scanned
    again. No rows give no groups, and without ``by`` one row with 0.
    """
    return sketches.groupBy(*by).agg(
        F.coalesce(F.sum("record_count"), F.lit(0)).alias("record_count"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("run_sketch")), F.lit(0)).alias("run_count"),
    )
