"""Report measures: each takes a filtered analytics table and the grouping columns."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from housemark.functions.runs import as_milliseconds, as_seconds
from housemark.operators.percentiles import exact_median
from housemark.schemas import CONFIG_KEY, RUN_KEY
from housemark.sources.scratch import stage


def without_setup_stage(analytics: DataFrame) -> DataFrame:
    return analytics.where(~F.col("stage_name").isin("setup"))


def _run_totals(analytics: DataFrame, by: Sequence[str]) -> DataFrame:
    """Milliseconds per run: NULL, not 0, where nothing was measured."""
    keys = list(dict.fromkeys([*RUN_KEY, *by]))
    return analytics.groupBy(*keys).agg(
        F.sum(as_milliseconds(F.col("stage_time_delta"))).alias("__ms")
    )


def _mean_seconds(milliseconds: Column) -> Column:
    """Exact whatever the order of rows: integers are summed, then divided once."""
    return F.try_divide(F.sum(milliseconds), F.count(milliseconds) * F.lit(1000.0))


def _cost_ms() -> Column:
    return F.col("__ms") * F.col("cu_per_second")


def total_time(analytics: DataFrame, by: Sequence[str] = CONFIG_KEY) -> DataFrame:
    total = F.sum(as_milliseconds(F.col("stage_time_delta")))
    return analytics.groupBy(*by).agg(as_seconds(total).alias("total_time"))


def average_time(analytics: DataFrame, by: Sequence[str] = CONFIG_KEY) -> DataFrame:
    """Mean over runs of the time per run."""
    return _run_totals(analytics, by).groupBy(*by).agg(
        _mean_seconds(F.col("__ms")).alias("average_time")
    )


def median_time(analytics: DataFrame, by: Sequence[str] = CONFIG_KEY) -> DataFrame:
    """Median over runs of the time per run."""
    runs = _run_totals(analytics, by).select(*by, as_seconds(F.col("__ms")).alias("__time"))
    return exact_median(stage(runs, "runs"), by, "__time", "median_time")


def run_count(
    analytics: DataFrame, by: Sequence[str] = CONFIG_KEY, approximate: bool = False
) -> DataFrame:
    """Distinct run timestamps; on request estimated by a sketch."""
    counter = F.approx_count_distinct if approximate else F.count_distinct
    return analytics.groupBy(*by).agg(counter("run_timestamp").alias("run_count"))


def median_stage_time(analytics: DataFrame) -> DataFrame:
    keys = ["workload_name", "configuration", "cu_per_second", "stage_name"]
    times = without_setup_stage(analytics).select(*keys, "stage_time_delta")
    return exact_median(stage(times, "times"), keys, "stage_time_delta", "median_stage_time")


def average_cost(analytics: DataFrame, by: Sequence[str] = CONFIG_KEY) -> DataFrame:
    return _run_totals(analytics, by).groupBy(*by).agg(
        _mean_seconds(_cost_ms()).alias("average_cost")
    )


def median_cost(analytics: DataFrame, by: Sequence[str] = CONFIG_KEY) -> DataFrame:
    runs = _run_totals(analytics, by).select(*by, as_seconds(_cost_ms()).alias("__cost"))
    return exact_median(stage(runs, "runs"), by, "__cost", "median_cost")


def time_cost_scatter(analytics: DataFrame) -> DataFrame:
    """Median time, median cost and number of runs per point of the scatter chart."""
    by = ["platform", "workload_name", "configuration"]
    runs = stage(
        _run_totals(without_setup_stage(analytics), by).select(
            *by,
            "run_timestamp",
            as_seconds(F.col("__ms")).alias("__time"),
            as_seconds(_cost_ms()).alias("__cost"),
        ),
        "runs",
    )
    # Both medians in one pass, and groups with a NULL label kept.
    measured = runs.select(
        *by,
        F.inline(
            F.array(
                F.struct(F.lit("time").alias("__kind"), F.col("__time").alias("__value")),
                F.struct(F.lit("cost").alias("__kind"), F.col("__cost").alias("__value")),
            )
        ),
    )
    medians = exact_median(measured, [*by, "__kind"], "__value", "__median").select(
        *by,
        F.when(F.col("__kind") == "time", F.col("__median")).alias("median_time"),
        F.when(F.col("__kind") == "cost", F.col("__median")).alias("median_cost"),
    )
    points = medians.unionByName(run_count(runs, by), allowMissingColumns=True)
    return points.groupBy(*by).agg(
        *[F.max(name).alias(name) for name in ("median_time", "median_cost", "run_count")]
    )


#: Groupings that the report's pages use, from the finest to all rows.
CONTEXTS: tuple[tuple[str, ...], ...] = (
    tuple(CONFIG_KEY),
    ("platform", "configuration"),
    ("workload_name",),
    ("platform",),
    (),
)


def measures_by_context(
    analytics: DataFrame, contexts: Sequence[Sequence[str]] = CONTEXTS
) -> DataFrame:
    """All measures under several groupings, out of one row for each run.

    ``context`` names the grouping by its columns, joined with commas; columns that are not
    part of it are NULL, and a NULL label within it is a group. The log is read and shuffled
    once, into totals by run, which are written; each run then counts in every context. Equal
    to the single measures with ``by``; the median of a group without a measured run is NULL.
    """
    names = list(dict.fromkeys(name for context in contexts for name in context))
    runs = stage(
        _run_totals(analytics, names).select(
            *names,
            "run_timestamp",
            F.col("__ms").alias("time"),
            _cost_ms().alias("cost"),
        ),
        "runs",
    )
    kinds = runs.schema

    def scope(context: Sequence[str]) -> Column:
        kept = [
            (F.col(n) if n in context else F.lit(None).cast(kinds[n].dataType)).alias(n) for n in names
        ]
        return F.struct(F.lit(",".join(context)).alias("context"), *kept)

    scoped = runs.select(
        F.inline(F.array(*map(scope, contexts))), "run_timestamp", "time", "cost"
    )
    keys = ["context", *names]
    simple = scoped.groupBy(*keys).agg(
        F.count_distinct("run_timestamp").alias("run_count"),
        as_seconds(F.sum("time")).alias("total_time"),
        _mean_seconds(F.col("time")).alias("average_time"),
        _mean_seconds(F.col("cost")).alias("average_cost"),
    )
    measured = scoped.select(
        *keys,
        F.inline(
            F.array(
                *(
                    F.struct(F.lit(kind).alias("__kind"), as_seconds(F.col(kind)).alias("__value"))
                    for kind in ("time", "cost")
                )
            )
        ),
    )
    medians = exact_median(measured, [*keys, "__kind"], "__value", "__median").select(
        *keys,
        *(
            F.when(F.col("__kind") == kind, F.col("__median")).alias(f"median_{kind}")
            for kind in ("time", "cost")
        ),
    )
    # Two rows of medians and one of the rest meet by grouping, which keeps NULL labels.
    together = simple.unionByName(medians, allowMissingColumns=True)
    found = (
        "run_count", "total_time", "average_time", "median_time", "average_cost", "median_cost"
    )
    return together.groupBy(*keys).agg(*(F.max(name).alias(name) for name in found))
