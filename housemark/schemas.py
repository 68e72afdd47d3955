"""Schemas, keys and fixed reference values shared by all modules."""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def layout(*fields: tuple[str, T.DataType]) -> T.StructType:
    """A schema of nullable fields."""
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


TEXT, REAL, LONG, INT = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()

# Positional layout of the headerless price-paid files.
PRICE_PAID_RAW = layout(
    ("transaction_unique_identifier", TEXT),
    ("price", REAL),
    ("date_of_transfer", T.TimestampType()),
    ("postcode", TEXT),
    ("property_type", TEXT),
    ("old_new", TEXT),
    ("duration", TEXT),
    ("paon", TEXT),
    ("saon", TEXT),
    ("street", TEXT),
    ("locality", TEXT),
    ("town_city", TEXT),
    ("district", TEXT),
    ("county", TEXT),
    ("ppd_category_type", TEXT),
    ("record_status", TEXT),
)

CLEAN_COLUMNS = [
    "price",
    "date_of_transfer",
    "postcode",
    "postcode_area",
    "property_type",
    "old_new",
    "town_city",
    "district",
    "county",
]

# What a clean row needs from the raw file: everything but the derived area.
RAW_COLUMNS_USED = [name for name in CLEAN_COLUMNS if name != "postcode_area"]

PRICES = layout(
    ("price", REAL),
    ("date_of_transfer", T.DateType()),
    ("postcode_area", TEXT),
    ("town_city", TEXT),
    ("property_type", TEXT),
    ("old_new", TEXT),
)
PRICES_BY_YEAR = layout(*((f.name, f.dataType) for f in PRICES), ("year", INT))

DATES = layout(
    ("date", T.DateType()),
    ("year", INT),
    ("month", INT),
    ("month_name", TEXT),
    ("day", INT),
    ("weekday", INT),
    ("weekday_name", TEXT),
    ("day_of_year", INT),
)

LOCATION_COLUMNS = ["county", "district", "town_city"]

RUN_RECORD = layout(
    ("platform", TEXT),
    ("configuration", TEXT),
    ("workload_name", TEXT),
    ("run_timestamp", TEXT),
    ("stage_name", TEXT),
    ("stage_time", T.TimestampType()),
    ("cpu_count", LONG),
    ("cpu_usage", REAL),
    ("memory", REAL),
    ("memory_usage", REAL),
)

RUN_LOG = T.StructType(
    RUN_RECORD.fields
    + [T.StructField("order", INT, True), T.StructField("stage_time_delta", REAL, True)]
)

STAGES = layout(
    ("stage_name", TEXT), ("stage_order", LONG), ("phase", TEXT), ("phase_order", LONG)
)

CONFIGURATIONS = layout(
    ("configuration", TEXT),
    ("configuration_scale", TEXT),
    ("total_v_cores", LONG),
    ("cu_per_second", LONG),
)

ONE_RUN = ["platform", "configuration", "workload_name", "run_timestamp"]
RUN_KEY = ONE_RUN + ["cu_per_second"]
CONFIG_KEY = ["platform", "configuration", "workload_name", "cu_per_second"]

# Codes of the price-paid data.
PROPERTY_TYPES = {
    "D": "Detached",
    "S": "Semi-Detached",
    "T": "Terraced",
    "F": "Flat/Maisonette",
    "O": "Other",
}
OLD_NEW = {"Y": "New", "N": "Old"}
POSTCODE_AREA_PATTERN = r"^([A-Z]{1,2})"

# stage_name, stage_order, phase, phase_order.
STAGE_ROWS = [
    ("start", 1, "start_and_setup", 1),
    ("setup", 2, "start_and_setup", 1),
    ("ingest", 3, "ingest_and_transform", 2),
    ("transform", 4, "ingest_and_transform", 2),
    ("write_prices", 5, "create_and_write", 3),
    ("write_locations", 6, "create_and_write", 3),
    ("write_dates", 7, "create_and_write", 3),
    ("read_prices", 8, "read_and_summarise", 4),
    ("read_dates", 9, "read_and_summarise", 4),
    ("join_and_summarise", 10, "read_and_summarise", 4),
]
SETUP_PHASE = "start_and_setup"

# The order in which a run passes its stages.
EXECUTION_ORDER = [
    "start",
    "setup",
    "ingest",
    "transform",
    "write_prices",
    "write_dates",
    "write_locations",
    "read_prices",
    "read_dates",
    "join_and_summarise",
]

# Configuration, configuration_scale, total_v_cores, cu_per_second.
CONFIGURATION_ROWS = [
    ("02 vCores", "10", 2, 1),
    ("04 vCores", "20", 4, 2),
    ("08 vCores", "30", 8, 4),
    ("16 vCores", "40", 16, 8),
    ("32 vCores", "50", 32, 16),
    ("01 executors 04/04 cores 28g/28g memory", "25", 8, 4),
    ("02 executors 04/04 cores 28g/28g memory", "34", 12, 6),
    ("01 executors 08/08 cores 56g/56g memory", "32", 16, 8),
    ("04 executors 04/04 cores 28g/28g memory", "46", 20, 10),
    ("02 executors 08/08 cores 56g/56g memory", "43", 24, 12),
    ("04 executors 08/08 cores 56g/56g memory", "55", 40, 20),
]

# Configurations the report looks at, and the two default ones.
REPORTED_CONFIGURATIONS = [
    "02 vCores",
    "04 vCores",
    "08 vCores",
    "01 executors 04/04 cores 28g/28g memory",
    "16 vCores",
    "01 executors 08/08 cores 56g/56g memory",
    "02 executors 08/08 cores 56g/56g memory",
    "32 vCores",
    "04 executors 08/08 cores 56g/56g memory",
]
DEFAULT_CONFIGURATIONS = ["01 executors 08/08 cores 56g/56g memory", "02 vCores"]


def literal_rows(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A small fixed table that is made inside the plan, by one task of the JVM."""
    names = schema.fieldNames()
    text = json.dumps([dict(zip(names, row)) for row in rows])
    return spark.range(0, 1, 1, 1).select(
        F.inline(F.from_json(F.lit(text), T.ArrayType(schema)))
    )


def stages(spark: SparkSession) -> DataFrame:
    """The ten literal stage rows."""
    return literal_rows(spark, STAGE_ROWS, STAGES)


def configurations(spark: SparkSession) -> DataFrame:
    """The eleven literal configuration rows."""
    return literal_rows(spark, CONFIGURATION_ROWS, CONFIGURATIONS)
