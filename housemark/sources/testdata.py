"""Views that give the test tables the shape of price-paid rows and run records."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from housemark.operators.ordered import KEY_ROWS, Running, running
from housemark.operators.run_log import derive_configuration
from housemark.schemas import (
    EXECUTION_ORDER,
    INT,
    PRICE_PAID_RAW,
    RUN_RECORD,
    TEXT,
    layout,
    literal_rows,
)

# Settings that the runs were scheduled with, by slot. The last one
# has no row in the configuration table.
_SETTINGS = [
    (0, 2, None, None, None, None, None),
    (1, 4, None, None, None, None, None),
    (2, 8, None, None, None, None, None),
    (3, 16, None, None, None, None, None),
    (4, 32, None, None, None, None, None),
    (5, None, 1, 4, 4, "28g", "28g"),
    (6, None, 2, 4, 4, "28g", "28g"),
    (7, None, 1, 8, 8, "56g", "56g"),
    (8, None, 4, 4, 4, "28g", "28g"),
    (9, None, 2, 8, 8, "56g", "56g"),
    (10, None, 4, 8, 8, "56g", "56g"),
    (11, 64, None, None, None, None, None),
]
_SETTINGS_SCHEMA = layout(
    ("slot", INT),
    ("v_cores", INT),
    ("executor_number", INT),
    ("driver_cores", INT),
    ("executor_cores", INT),
    ("driver_memory", TEXT),
    ("executor_memory", TEXT),
)


# The columns in use; a given schema saves Spark a look into the files.
_TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_linenumber int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, value double, props string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(_TABLES[name]).parquet(f"{folder}/{name}.parquet")


def price_paid_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as house sales: customer segment, nation and region give the place.

    No join is hinted: Spark broadcasts what it finds small and shuffles the rest.
    """
    key = F.col("o_orderkey")
    rows = (
        table(spark, folder, "orders")
        .join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    priority = F.substring("o_orderpriority", 1, 1).try_cast("int")
    made = {
        "transaction_unique_identifier": key.cast("string"),
        "price": F.col("o_totalprice"),
        "date_of_transfer": F.col("o_orderdate").cast("timestamp"),
        "postcode": F.when(key % 10 == 0, F.lit(None))
        .when(key % 10 == 1, F.lit("9ZZ 1AA"))
        .when(key % 10 == 2, F.concat(F.substring("r_name", 1, 1), F.lit("1 1AA")))
        .otherwise(F.concat(F.substring("r_name", 1, 2), F.lit("2 2BB"))),
        "property_type": F.when(key % 97 == 0, F.lit("X")).otherwise(
            F.substring(F.lit("DSTFO"), priority, F.lit(1))
        ),
        "old_new": F.when(F.col("o_orderstatus") == "F", "Y")
        .when(F.col("o_orderstatus") == "O", "N")
        .otherwise(F.col("o_orderstatus")),
        "duration": F.lit("F"),
        "paon": F.concat(F.lit("The "), F.lit('"Old"'), F.lit(" House, "), key.cast("string")),
        "saon": F.lit(None).cast("string"),
        "street": F.lit("HIGH STREET, NORTH"),
        "locality": F.lit(None).cast("string"),
        "town_city": F.col("c_mktsegment"),
        "district": F.col("n_name"),
        "county": F.col("r_name"),
        "ppd_category_type": F.lit("A"),
        "record_status": F.lit("A"),
    }
    return rows.select(*[made[name].alias(name) for name in PRICE_PAID_RAW.fieldNames()])


def price_paid_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of ``price_paid_raw`` as texts, some of which are no prices or dates."""
    raw = price_paid_raw(spark, folder)
    key = F.col("transaction_unique_identifier").cast("bigint")
    odd = {
        "price": F.when(key % 89 == 0, "n/a").when(key % 67 == 0, "").otherwise(F.col("price").cast("string")),
        "date_of_transfer": F.when(key % 83 == 0, "2025-02-30 00:00")
        .when(key % 97 == 5, "bad")
        .otherwise(F.date_format("date_of_transfer", "yyyy-MM-dd HH:mm")),
    }
    return raw.withColumns(odd)


def fields_of_line() -> Column:
    """How many fields of a row of ``price_paid_texts`` its line has; NULL for all."""
    key = F.col("transaction_unique_identifier").cast("bigint")
    return F.when(key % 101 == 0, 3)


def event_settings(spark: SparkSession, folder: str) -> DataFrame:
    """Events with the settings that their user ran with."""
    slots = literal_rows(spark, _SETTINGS, _SETTINGS_SCHEMA)
    events = table(spark, folder, "events").withColumn(
        "slot", (F.col("user_id") % len(_SETTINGS)).cast("int")
    )
    return events.join(F.broadcast(slots), "slot")  # twelve literal rows


def run_records(spark: SparkSession, folder: str) -> DataFrame:
    """Events as stage records: every ten events of a user, in time order, are one run."""
    numbered = running(
        table(spark, folder, "events").select(
            "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value", "props"
        ),
        ["user_id"],
        ["ts", "event_id"],
        Running(number="number"),
        key_rows=KEY_ROWS,
    )
    slots = derive_configuration(literal_rows(spark, _SETTINGS, _SETTINGS_SCHEMA))
    size = len(EXECUTION_ORDER)
    place = F.col("number") - 1
    stage_names = F.array(*[F.lit(name) for name in EXECUTION_ORDER])
    cores = F.col("total_v_cores")
    made = {
        "platform": F.when(F.col("v_cores").isNull(), "cluster").otherwise("single_node"),
        "configuration": F.col("configuration"),
        "workload_name": F.concat_ws(
            "_", F.lit("engine"), F.call_function("div", F.col("user_id"), F.lit(len(_SETTINGS))) % 4
        ),
        "run_timestamp": F.concat_ws(
            "_", F.col("user_id"), F.call_function("div", place, F.lit(size))
        ),
        "stage_name": F.element_at(stage_names, (place % size + 1).cast("int")),
        "stage_time": F.col("ts"),
        "cpu_count": cores,
        "cpu_usage": F.get_json_object("props", "$.k").try_cast("double"),
        "memory": (cores * 8).cast("double"),
        "memory_usage": F.col("value"),
    }
    return numbered.join(
        F.broadcast(slots),  # twelve literal rows
        (F.col("user_id") % len(_SETTINGS)).cast("int") == slots["slot"],
    ).select(*[made[name].alias(name) for name in RUN_RECORD.fieldNames()])


# A run of these views has at most ten records, so plain windows do.
RECORDS_PER_RUN_ARE_BOUNDED = True
