"""The same queries in ANSI SQL over the test tables, written on their own."""

_RAW = """
raw AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS transaction_unique_identifier,
         o_totalprice AS price,
         o_orderdate AS date_of_transfer,
         CASE o_orderkey % 10
           WHEN 0 THEN NULL
           WHEN 1 THEN '9ZZ 1AA'
           WHEN 2 THEN substr(r_name, 1, 1) || '1 1AA'
           ELSE substr(r_name, 1, 2) || '2 2BB' END AS postcode,
         CASE WHEN o_orderkey % 97 = 0 THEN 'X'
              ELSE substr('DSTFO', CAST(substr(o_orderpriority, 1, 1) AS INTEGER), 1)
         END AS property_type,
         CASE o_orderstatus WHEN 'F' THEN 'Y' WHEN 'O' THEN 'N' ELSE o_orderstatus END AS old_new,
         'F' AS duration,
         'The "Old" House, ' || CAST(o_orderkey AS VARCHAR) AS paon,
         CAST(NULL AS VARCHAR) AS saon,
         'HIGH STREET, NORTH' AS street,
         CAST(NULL AS VARCHAR) AS locality,
         c_mktsegment AS town_city,
         n_name AS district,
         r_name AS county,
         'A' AS ppd_category_type,
         'A' AS record_status
  FROM orders
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
)"""

_KIND = """CASE property_type WHEN 'D' THEN 'Detached' WHEN 'S' THEN 'Semi-Detached'
  WHEN 'T' THEN 'Terraced' WHEN 'F' THEN 'Flat/Maisonette' WHEN 'O' THEN 'Other'
  ELSE property_type END"""
_AGE = "CASE old_new WHEN 'Y' THEN 'New' WHEN 'N' THEN 'Old' ELSE old_new END"

_CLEAN = f"""{_RAW},
clean AS (
  SELECT price, CAST(date_of_transfer AS DATE) AS date_of_transfer, postcode,
         regexp_extract(postcode, '^([A-Z]{{1,2}})', 1) AS postcode_area,
         {_KIND} AS property_type, {_AGE} AS old_new, town_city, district, county
  FROM raw
)"""

_DATES = f"""{_CLEAN},
days AS (
  SELECT CAST(day AS DATE) AS date
  FROM (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS day
        FROM (SELECT min(date_of_transfer) AS lo, max(date_of_transfer) AS hi FROM clean))
),
dates AS (
  SELECT date,
         CAST(year(date) AS INTEGER) AS year,
         CAST(month(date) AS INTEGER) AS month,
         monthname(date) AS month_name,
         CAST(day(date) AS INTEGER) AS day,
         CAST(dayofweek(date) AS INTEGER) AS weekday,
         dayname(date) AS weekday_name,
         CAST(dayofyear(date) AS INTEGER) AS day_of_year
  FROM days
)"""

_MONTHS = f"""{_DATES},
priced AS (
  SELECT price, date_of_transfer, postcode_area, town_city, property_type, old_new,
         strftime(date, '%Y_%m') AS month_tag
  FROM clean LEFT JOIN dates ON date_of_transfer = date
  WHERE property_type <> 'Other'
)"""

_FIGURES = """median(price) AS median_price, min(price) AS min_price, max(price) AS max_price"""

_MONTHLY = f"""WITH {_MONTHS}
SELECT month_tag, property_type, count(*) AS number_of_transactions, {_FIGURES}
FROM priced GROUP BY month_tag, property_type"""

_YM = f"""SELECT CAST(year(date_of_transfer) AS INTEGER) AS year,
       CAST(month(date_of_transfer) AS INTEGER) AS month_number, property_type,
       count(*) AS number_of_transactions, {_FIGURES}
FROM raw GROUP BY ALL"""

_RECENT = f"""WITH {_RAW}
SELECT *, year || '_' || lpad(CAST(month_number AS VARCHAR), 2, '0') AS year_month
FROM ({_YM}) WHERE year > 1997 AND property_type <> 'O'"""

_RAW_COLUMNS = """transaction_unique_identifier, price, date_of_transfer, postcode, property_type,
  old_new, duration, paon, saon, street, locality, town_city, district, county,
  ppd_category_type, record_status"""

_TEXTS = f"""{_RAW},
texts AS (
  SELECT raw.* REPLACE (
           CASE WHEN k % 89 = 0 THEN 'n/a' WHEN k % 67 = 0 THEN NULL ELSE CAST(price AS VARCHAR) END
             AS price,
           CASE WHEN k % 83 = 0 THEN '2025-02-30 00:00' WHEN k % 97 = 5 THEN 'bad'
                ELSE strftime(date_of_transfer, '%Y-%m-%d %H:%M') END AS date_of_transfer,
           CASE WHEN k % 101 <> 0 THEN postcode END AS postcode,
           CASE WHEN k % 101 <> 0 THEN property_type END AS property_type,
           CASE WHEN k % 101 <> 0 THEN old_new END AS old_new,
           CASE WHEN k % 101 <> 0 THEN town_city END AS town_city,
           CASE WHEN k % 101 <> 0 THEN district END AS district,
           CASE WHEN k % 101 <> 0 THEN county END AS county),
         k % 101 = 0 AS is_short
  FROM raw, LATERAL (SELECT CAST(transaction_unique_identifier AS BIGINT) AS k)
),
tested AS (
  SELECT *, try_cast(price AS DOUBLE) AS price_value,
         try_cast(date_of_transfer AS TIMESTAMP) AS date_value,
         price IS NOT NULL AND try_cast(price AS DOUBLE) IS NULL AS bad_price,
         try_cast(date_of_transfer AS TIMESTAMP) IS NULL AS bad_date
  FROM texts
)"""

_DECODED = """
WITH entries AS (
  SELECT 'O' || o_orderkey AS code, min(o_orderstatus || ' ' || o_orderpriority) AS meaning
  FROM orders WHERE o_orderkey % 10 <> 2 GROUP BY 1
),
lines AS (
  SELECT l_orderkey, l_linenumber,
         CASE WHEN l_orderkey % 3 = 0 THEN 'O3' WHEN l_orderkey % 50 <> 1 THEN 'O' || l_orderkey END
           AS code
  FROM lineitem
)
SELECT l_orderkey, l_linenumber, code, coalesce(meaning, code) AS state
FROM lines LEFT JOIN entries USING (code)"""

_PRICE_QUERIES = {
    "prices_of_years": f"""WITH {_CLEAN}
SELECT price, date_of_transfer, postcode_area, town_city, property_type, old_new,
       CAST(year(date_of_transfer) AS INTEGER) AS year
FROM clean WHERE property_type <> 'Other' AND year(date_of_transfer) BETWEEN 1998 AND 1999""",
    "monthly_summary_of_years": f"""{_MONTHLY.replace("FROM priced", "FROM priced WHERE year(date_of_transfer) BETWEEN 1998 AND 1999")}""",
    "weekend_summary": f"""WITH {_MONTHS}
SELECT month_tag, property_type, count(*) AS number_of_transactions, {_FIGURES}
FROM priced JOIN dates ON date = date_of_transfer
WHERE month IN (12, 1, 2) AND year BETWEEN 1996 AND 1997 AND weekday IN (0, 6)
GROUP BY month_tag, property_type""",
    # A sketch keeps as many values as a group has here, so its quantiles are values at ranks.
    "yearly_prices_sketched": f"""WITH {_MONTHS}
SELECT CAST(substr(month_tag, 1, 4) AS INTEGER) AS year, property_type,
       count(*) AS number_of_transactions, quantile_disc(price, 0.25) AS lower_quartile,
       quantile_disc(price, 0.5) AS median_price, quantile_disc(price, 0.75) AS upper_quartile,
       min(price) AS min_price, max(price) AS max_price
FROM priced GROUP BY ALL""",
    "decode_by_dictionary": _DECODED,
    "decode_by_large_dictionary": _DECODED,
    "ingest_rejects": f"""WITH {_TEXTS}
SELECT 'price' AS column_name, count(*) AS row_count, count(price_value) AS value_count,
       count(*) FILTER (bad_price) AS reject_count FROM tested
UNION ALL
SELECT 'date_of_transfer', count(*), count(date_value), count(*) FILTER (bad_date) FROM tested
UNION ALL
SELECT 'number_of_fields', count(*), count(*) FILTER (NOT is_short), count(*) FILTER (is_short)
FROM tested""",
    "ingest_quarantine": f"""WITH {_TEXTS}
SELECT transaction_unique_identifier,
       concat_ws(',', CASE WHEN bad_price THEN 'price' END,
                 CASE WHEN bad_date THEN 'date_of_transfer' END,
                 CASE WHEN is_short THEN 'number_of_fields' END) AS failed_columns,
       price AS price_text, date_of_transfer AS date_text, county AS county_text
FROM tested WHERE bad_price OR bad_date OR is_short""",
    "ingest_accepted": f"""WITH {_TEXTS}
SELECT price_value AS price, CAST(date_value AS DATE) AS date_of_transfer, postcode,
       regexp_extract(postcode, '^([A-Z]{{1,2}})', 1) AS postcode_area,
       {_KIND} AS property_type, {_AGE} AS old_new, town_city, district, county
FROM tested""",
    "csv_ingest": f"WITH {_RAW} SELECT {_RAW_COLUMNS} FROM raw",
    "csv_usecols": f"""WITH {_RAW}
SELECT price, date_of_transfer, postcode, property_type, old_new, town_city, district, county
FROM raw""",
    "union_yearly": f"WITH {_RAW} SELECT {_RAW_COLUMNS} FROM raw",
    "decode_property_type": f"""WITH {_RAW}
SELECT transaction_unique_identifier, property_type AS code, {_KIND} AS property_type FROM raw""",
    "decode_old_new": f"""WITH {_RAW}
SELECT transaction_unique_identifier, old_new AS code, {_AGE} AS old_new FROM raw""",
    "decode_by_map": f"""WITH {_RAW}
SELECT transaction_unique_identifier,
       coalesce(element_at(MAP {{'D': 'Detached', 'S': 'Semi-Detached', 'T': 'Terraced',
         'F': 'Flat/Maisonette', 'O': 'Other'}}, property_type)[1], property_type) AS property_type,
       coalesce(element_at(MAP {{'Y': 'New', 'N': 'Old'}}, old_new)[1], old_new) AS old_new
FROM raw""",
    "postcode_area": f"""WITH {_RAW}
SELECT transaction_unique_identifier, postcode,
       regexp_extract(postcode, '^([A-Z]{{1,2}})', 1) AS postcode_area,
       nullif(regexp_extract(postcode, '^([A-Z]{{1,2}})', 1), '') AS postcode_area_or_null
FROM raw""",
    "clean_price_paid": f"WITH {_CLEAN} SELECT * FROM clean",
    "prices_fact": f"""WITH {_CLEAN}
SELECT price, date_of_transfer, postcode_area, town_city, property_type, old_new FROM clean""",
    "prices_readback": f"""WITH {_CLEAN}
SELECT price, date_of_transfer, postcode_area, town_city, property_type, old_new FROM clean
WHERE property_type <> 'Other'""",
    "date_bounds": f"""WITH {_CLEAN}
SELECT min(date_of_transfer) AS min_date, max(date_of_transfer) AS max_date FROM clean""",
    "dates_dim": f"WITH {_DATES} SELECT * FROM dates",
    "dates_readback": f"WITH {_DATES} SELECT *, strftime(date, '%Y_%m') AS month_tag FROM dates",
    "locations_dim": f"WITH {_CLEAN} SELECT DISTINCT county, district, town_city FROM clean",
    "locations_readback": f"WITH {_CLEAN} SELECT DISTINCT county, district, town_city FROM clean",
    "price_dates_join": f"WITH {_MONTHS} SELECT * FROM priced",
    "monthly_summary": _MONTHLY,
    # A sketch of more entries than a group has rows gives the lower median.
    "monthly_summary_approx": _MONTHLY.replace("median(price)", "quantile_disc(price, 0.5)"),
    "files_to_summary": _MONTHLY,
    "monthly_nonnull": f"""WITH {_MONTHS}
SELECT month_tag, property_type, count(price) AS number_of_transactions, {_FIGURES}
FROM priced GROUP BY month_tag, property_type""",
    "summary_preview": f"{_MONTHLY} ORDER BY month_tag, property_type LIMIT 5",
    "monthly_summary_ym": f"WITH {_RAW} {_YM}",
    "recent_summary": _RECENT,
    "files_to_recent_summary": _RECENT,
}

_STAGES = """
stages(stage_name, stage_order, phase, phase_order) AS (
  SELECT col0, CAST(col1 AS BIGINT), col2, CAST(col3 AS BIGINT) FROM (VALUES
    ('start', 1, 'start_and_setup', 1),
    ('setup', 2, 'start_and_setup', 1),
    ('ingest', 3, 'ingest_and_transform', 2),
    ('transform', 4, 'ingest_and_transform', 2),
    ('write_prices', 5, 'create_and_write', 3),
    ('write_locations', 6, 'create_and_write', 3),
    ('write_dates', 7, 'create_and_write', 3),
    ('read_prices', 8, 'read_and_summarise', 4),
    ('read_dates', 9, 'read_and_summarise', 4),
    ('join_and_summarise', 10, 'read_and_summarise', 4))
)"""

_CONFIGURATIONS = """
configurations(configuration, configuration_scale, total_v_cores, cu_per_second) AS (
  SELECT col0, col1, CAST(col2 AS BIGINT), CAST(col3 AS BIGINT) FROM (VALUES
    ('02 vCores', '10', 2, 1),
    ('04 vCores', '20', 4, 2),
    ('08 vCores', '30', 8, 4),
    ('16 vCores', '40', 16, 8),
    ('32 vCores', '50', 32, 16),
    ('01 executors 04/04 cores 28g/28g memory', '25', 8, 4),
    ('02 executors 04/04 cores 28g/28g memory', '34', 12, 6),
    ('01 executors 08/08 cores 56g/56g memory', '32', 16, 8),
    ('04 executors 04/04 cores 28g/28g memory', '46', 20, 10),
    ('02 executors 08/08 cores 56g/56g memory', '43', 24, 12),
    ('04 executors 08/08 cores 56g/56g memory', '55', 40, 20))
)"""

_SLOTS = """
slots(slot, configuration, cores) AS (VALUES
  (0, '02 vCores', 2),
  (1, '04 vCores', 4),
  (2, '08 vCores', 8),
  (3, '16 vCores', 16),
  (4, '32 vCores', 32),
  (5, '01 executors 04/04 cores 28g/28g memory', 8),
  (6, '02 executors 04/04 cores 28g/28g memory', 12),
  (7, '01 executors 08/08 cores 56g/56g memory', 16),
  (8, '04 executors 04/04 cores 28g/28g memory', 20),
  (9, '02 executors 08/08 cores 56g/56g memory', 24),
  (10, '04 executors 08/08 cores 56g/56g memory', 40),
  (11, '64 vCores', 64)
)"""

_RECORDS = f"""{_SLOTS},
placed AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place
  FROM events
),
records AS (
  SELECT CASE WHEN configuration LIKE '%executors%' THEN 'cluster' ELSE 'single_node' END
           AS platform,
         configuration,
         'engine_' || CAST((user_id // 12) % 4 AS VARCHAR) AS workload_name,
         CAST(user_id AS VARCHAR) || '_' || CAST(place // 10 AS VARCHAR) AS run_timestamp,
         CASE place % 10 WHEN 0 THEN 'start' WHEN 1 THEN 'setup' WHEN 2 THEN 'ingest'
           WHEN 3 THEN 'transform' WHEN 4 THEN 'write_prices' WHEN 5 THEN 'write_dates'
           WHEN 6 THEN 'write_locations' WHEN 7 THEN 'read_prices' WHEN 8 THEN 'read_dates'
           ELSE 'join_and_summarise' END AS stage_name,
         ts AS stage_time,
         CAST(cores AS BIGINT) AS cpu_count,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS cpu_usage,
         CAST(cores * 8 AS DOUBLE) AS memory,
         value AS memory_usage
  FROM placed JOIN slots ON user_id % 12 = slot
)"""

_RUN = "platform, configuration, workload_name, run_timestamp"

_LOG = f"""{_RECORDS},
timed AS (
  SELECT *,
         row_number() OVER run AS place_in_run,
         epoch_us(stage_time) - lag(epoch_us(stage_time)) OVER run AS gap
  FROM records
  WINDOW run AS (PARTITION BY {_RUN} ORDER BY stage_time, stage_name)
),
log AS (
  SELECT {_RUN}, stage_name, stage_time, cpu_count, cpu_usage, memory, memory_usage,
         CAST(place_in_run AS INTEGER) AS "order",
         CAST((gap + 500) // 1000 AS DOUBLE) / 1000.0 AS stage_time_delta
  FROM timed
)"""

_ANALYTICS = f"""{_LOG}, {_STAGES}, {_CONFIGURATIONS},
measured AS (
  SELECT log.*, stage_order, phase, phase_order, configuration_scale, total_v_cores,
         cu_per_second, CAST(round(stage_time_delta * 1000) AS BIGINT) AS ms
  FROM log JOIN stages USING (stage_name) JOIN configurations USING (configuration)
),
analytics AS (
  SELECT * EXCLUDE (ms),
         CAST(sum(ms) OVER (PARTITION BY {_RUN} ORDER BY "order"
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / 1000.0
           AS cumulative_time
  FROM measured
)"""

_REPORTED = f"""{_ANALYTICS},
reported AS (
  SELECT * FROM analytics WHERE configuration IN (
    '02 vCores', '04 vCores', '08 vCores', '01 executors 04/04 cores 28g/28g memory',
    '16 vCores', '01 executors 08/08 cores 56g/56g memory',
    '02 executors 08/08 cores 56g/56g memory', '32 vCores',
    '04 executors 08/08 cores 56g/56g memory')
)"""

_CONFIG = "platform, configuration, workload_name, cu_per_second"
_RUN_KEY = f"{_RUN}, cu_per_second"
_MS = "CAST(sum(CAST(round(stage_time_delta * 1000) AS BIGINT)) AS BIGINT)"

_REPORT = f"""{_REPORTED},
elapsed AS (
  SELECT {_RUN_KEY}, CAST(coalesce({_MS}, 0) AS DOUBLE) / 1000.0 AS total_elapsed_time
  FROM reported GROUP BY {_RUN_KEY}
),
execution AS (
  SELECT {_RUN_KEY}, CAST(coalesce({_MS}, 0) AS DOUBLE) / 1000.0 AS total_execution_time
  FROM reported WHERE phase <> 'start_and_setup' GROUP BY {_RUN_KEY}
),
median_elapsed AS (
  SELECT {_CONFIG}, median(total_elapsed_time) AS median_elapsed_time
  FROM elapsed GROUP BY {_CONFIG}
),
median_execution AS (
  SELECT {_CONFIG}, median(total_execution_time) AS median_execution_time
  FROM execution GROUP BY {_CONFIG}
),
cost AS (
  SELECT *, median_execution_time * cu_per_second AS total_cu_cost FROM median_execution
)"""

_RUN_TOTALS = f"""{_ANALYTICS},
totals AS (SELECT {_RUN_KEY}, {_MS} AS ms FROM analytics GROUP BY {_RUN_KEY}),
totals_without_setup AS (
  SELECT {_RUN_KEY}, {_MS} AS ms FROM analytics WHERE stage_name NOT IN ('setup')
  GROUP BY {_RUN_KEY}
)"""

_NUMBERS = ["cpu_count", "cpu_usage", "memory", "memory_usage", "order", "stage_time_delta"]
_TEXTS = ["platform", "configuration", "workload_name", "run_timestamp", "stage_name"]


def _number_profile(name: str) -> str:
    return f"""SELECT '{name}' AS column_name, count("{name}") AS value_count,
  count(*) - count("{name}") AS null_count,
  round(avg(CAST("{name}" AS DOUBLE)), 6) AS mean,
  round(stddev_samp(CAST("{name}" AS DOUBLE)), 6) AS std,
  CAST(NULL AS VARCHAR) AS first_text, CAST(NULL AS VARCHAR) AS last_text,
  min(CAST("{name}" AS DOUBLE)) AS minimum,
  round(quantile_cont(CAST("{name}" AS DOUBLE), 0.25), 6) AS lower_quartile,
  median(CAST("{name}" AS DOUBLE)) AS median,
  round(quantile_cont(CAST("{name}" AS DOUBLE), 0.75), 6) AS upper_quartile,
  max(CAST("{name}" AS DOUBLE)) AS maximum
FROM log"""


def _text_profile(name: str, text: str | None = None) -> str:
    text = text or name
    nothing = "CAST(NULL AS DOUBLE)"
    return f"""SELECT '{name}', count({name}), count(*) - count({name}), {nothing}, {nothing},
  min({text}), max({text}), {nothing}, {nothing}, {nothing}, {nothing}, {nothing} FROM log"""


_PROFILE = "\nUNION ALL\n".join(
    [_number_profile(n) for n in _NUMBERS]
    + [_text_profile(n) for n in _TEXTS]
    + [_text_profile("stage_time", "CAST(stage_time AS VARCHAR)")]
)

_ODD_LOG = f"""{_LOG}, {_STAGES}, {_CONFIGURATIONS},
odd AS (
  SELECT * REPLACE (CASE WHEN CAST(cpu_usage AS INTEGER) % 10 = 7 THEN 'teardown'
                         WHEN CAST(cpu_usage AS INTEGER) % 10 <> 3 THEN stage_name END AS stage_name)
  FROM log
),
known AS (
  SELECT odd.*, EXISTS (FROM stages s WHERE s.stage_name = odd.stage_name) AS has_stage,
         EXISTS (FROM configurations c WHERE c.configuration = odd.configuration) AS has_configuration
  FROM odd
)"""

_DRAWN = "md5('7:' || {})".format(
    " || ".join(
        f"coalesce(strlen({c}) || ':' || {c}, '-')"
        for c in ("platform", "configuration", "workload_name", "run_timestamp", "stage_name")
    )
)

_RUN_QUERIES = {
    "sample_rows": f"WITH {_REPORTED} SELECT * FROM reported ORDER BY {_DRAWN} LIMIT 5",
    "sample_share": f"""WITH {_REPORTED}
SELECT * FROM reported WHERE ('0x' || substr({_DRAWN}, 1, 8))::BIGINT < 214748364""",
    "unmatched_configurations": f"""WITH {_ODD_LOG}
SELECT 'stage_name' AS dimension, stage_name AS value, count(*) AS record_count,
       count(DISTINCT ({_RUN})) AS run_count, min(stage_time) AS first_time, max(stage_time) AS last_time
FROM known WHERE NOT has_stage GROUP BY stage_name
UNION ALL
SELECT 'configuration', configuration, count(*), count(DISTINCT ({_RUN})), min(stage_time),
       max(stage_time)
FROM known WHERE NOT has_configuration GROUP BY configuration""",
    "enrichment_balance": f"""WITH {_ODD_LOG}
SELECT count(*) AS record_count, count(*) FILTER (has_stage AND has_configuration) AS kept_count,
       count(*) FILTER (NOT has_stage AND has_configuration) AS unknown_stage_count,
       count(*) FILTER (has_stage AND NOT has_configuration) AS unknown_configuration_count,
       count(*) FILTER (NOT has_stage AND NOT has_configuration) AS unknown_both_count
FROM known""",
    "unmatched_customers": """
SELECT o_custkey AS c_custkey, count(*) AS record_count,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total_price
FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')
GROUP BY o_custkey""",
    "run_log": f"WITH {_RECORDS} SELECT * FROM records",
    "stage_order_delta": f"WITH {_LOG} SELECT * FROM log",
    "run_log_append": f"WITH {_LOG} SELECT * FROM log",
    "run_log_export": f"WITH {_LOG} SELECT * FROM log",
    "run_log_readback": f"WITH {_LOG} SELECT * FROM log",
    "run_started_at": """
SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS run_timestamp,
       date_trunc('second', ts) AS started_at
FROM events""",
    "configuration_derivation": f"""WITH {_SLOTS}
SELECT configuration, CAST(cores AS BIGINT) AS total_v_cores,
       CAST(cores // 2 AS BIGINT) AS cu_per_second, count(*) AS event_count
FROM events JOIN slots ON user_id % 12 = slot GROUP BY ALL""",
    "stages_dim": f"""WITH {_RECORDS}, {_STAGES}
SELECT stages.*, count(records.stage_name) AS record_count
FROM stages LEFT JOIN records ON records.stage_name = stages.stage_name
GROUP BY ALL""",
    "configurations_dim": f"""WITH {_RECORDS}, {_CONFIGURATIONS}
SELECT configurations.*, count(records.configuration) AS record_count
FROM configurations LEFT JOIN records ON records.configuration = configurations.configuration
GROUP BY ALL""",
    "run_wall_clock": f"""WITH {_RECORDS}
SELECT {_RUN},
       (epoch_us(max(stage_time)) - epoch_us(min(stage_time)) + 500) // 1000 AS wall_clock_ms
FROM records GROUP BY {_RUN}""",
    "profile_run_log": f"WITH {_LOG} {_PROFILE}",
    "log_with_stages": f"""WITH {_LOG}, {_STAGES}
SELECT log.*, stage_order, phase, phase_order FROM log JOIN stages USING (stage_name)""",
    "log_with_configurations": f"""WITH {_LOG}, {_CONFIGURATIONS}
SELECT log.*, configuration_scale, total_v_cores, cu_per_second
FROM log JOIN configurations USING (configuration)""",
    "cumulative_time": f"WITH {_ANALYTICS} SELECT * FROM analytics",
    "analytics_readback": f"WITH {_ANALYTICS} SELECT * FROM analytics",
    "analytics_incremental": f"WITH {_ANALYTICS} SELECT * FROM analytics",
    "analytics_cache": f"WITH {_ANALYTICS} SELECT * FROM analytics",
    "distinct_configurations": f"""WITH {_ANALYTICS}
SELECT DISTINCT configuration FROM analytics""",
    "selected_configurations": f"WITH {_REPORTED} SELECT * FROM reported",
    "elapsed_per_run": f"WITH {_REPORT} SELECT * FROM elapsed",
    "execution_per_run": f"WITH {_REPORT} SELECT * FROM execution",
    "median_elapsed": f"WITH {_REPORT} SELECT * FROM median_elapsed",
    "median_execution": f"WITH {_REPORT} SELECT * FROM median_execution",
    "unit_cost": f"WITH {_REPORT} SELECT * FROM cost",
    "default_environments": f"""WITH {_REPORT}
SELECT *, round(median_elapsed_time / min(median_elapsed_time) OVER () * 100, 1)
         AS percentage_of_min_time
FROM median_elapsed
WHERE configuration IN ('01 executors 08/08 cores 56g/56g memory', '02 vCores')""",
    "fastest_10": f"""WITH {_REPORT}
SELECT CAST(row_number() OVER (ORDER BY median_execution_time NULLS LAST, {_CONFIG}) AS INTEGER)
         AS rank, *,
       round(median_execution_time / min(median_execution_time) OVER () * 100, 1)
         AS percentage_of_min_time
FROM median_execution QUALIFY rank <= 10""",
    "cheapest_10": f"""WITH {_REPORT}
SELECT CAST(row_number() OVER (ORDER BY total_cu_cost NULLS LAST, {_CONFIG}) AS INTEGER) AS rank,
       workload_name, configuration, cu_per_second, median_execution_time, total_cu_cost,
       round(total_cu_cost / min(total_cu_cost) OVER () * 100, 1) AS percentage_of_min_cost
FROM cost QUALIFY rank <= 10""",
    "elapsed_vs_cost": f"""WITH {_REPORT}
SELECT {_CONFIG}, median_elapsed_time AS median_total_elapsed_time, median_execution_time,
       total_cu_cost
FROM median_elapsed JOIN cost USING ({_CONFIG})""",
    "execution_vs_cost": f"""WITH {_REPORT}
SELECT {_CONFIG}, m.median_execution_time AS median_total_execution_time,
       cost.median_execution_time, total_cu_cost
FROM median_execution m JOIN cost USING ({_CONFIG})""",
    "provisioning_median": f"""WITH {_REPORTED}
SELECT platform, configuration, median(stage_time_delta) AS median_provisioning_time
FROM reported WHERE stage_name = 'setup' GROUP BY platform, configuration""",
    "provisioning_boxplot": f"""WITH {_REPORTED}
SELECT configuration, platform, min(stage_time_delta) AS minimum_time,
       round(quantile_cont(stage_time_delta, 0.25), 6) AS lower_quartile,
       median(stage_time_delta) AS median_time,
       round(quantile_cont(stage_time_delta, 0.75), 6) AS upper_quartile,
       max(stage_time_delta) AS maximum_time
FROM reported WHERE stage_name = 'setup' GROUP BY configuration, platform""",
    "stage_cumulative_median": f"""WITH {_REPORTED}
SELECT {_CONFIG}, stage_name, "order", median(cumulative_time) AS median_cumulative_time
FROM reported WHERE phase <> 'start_and_setup' GROUP BY {_CONFIG}, stage_name, "order" """,
    "max_memory_by_stage": f"""WITH {_ANALYTICS}
SELECT configuration, stage_name, workload_name, max(memory_usage) AS max_memory_usage
FROM analytics GROUP BY ALL""",
    "run_detail": f"""WITH {_ANALYTICS}
SELECT run_timestamp, platform, workload_name, configuration, stage_name, stage_time_delta,
       cpu_count, CAST(sum(cu_per_second) AS BIGINT) AS sum_cu_per_second,
       sum(memory_usage) AS sum_memory_usage
FROM analytics GROUP BY ALL""",
    "total_time": f"""WITH {_ANALYTICS}
SELECT {_CONFIG}, CAST({_MS} AS DOUBLE) / 1000.0 AS total_time FROM analytics GROUP BY {_CONFIG}""",
    "average_time": f"""WITH {_RUN_TOTALS}
SELECT {_CONFIG}, CAST(sum(ms) AS DOUBLE) / (count(ms) * 1000.0) AS average_time
FROM totals GROUP BY {_CONFIG}""",
    "median_time": f"""WITH {_RUN_TOTALS}
SELECT {_CONFIG}, median(ms / 1000.0) AS median_time FROM totals GROUP BY {_CONFIG}""",
    "run_count": f"""WITH {_ANALYTICS}
SELECT {_CONFIG}, count(DISTINCT run_timestamp) AS run_count FROM analytics GROUP BY {_CONFIG}""",
    "run_count_sketched": f"""WITH {_ANALYTICS}
SELECT platform, workload_name, count(*) AS record_count,
       count(DISTINCT run_timestamp) AS run_count
FROM analytics
WHERE CAST(stage_time AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-21'
GROUP BY platform, workload_name""",
    "run_count_by_scope": f"""WITH {_ANALYTICS}
SELECT CASE WHEN grouping(configuration) = 0 THEN 'configuration'
            WHEN grouping(platform) = 0 THEN 'platform' ELSE 'all' END AS scope,
       coalesce(configuration, platform) AS value, count(*) AS record_count,
       count(DISTINCT run_timestamp) AS run_count
FROM analytics GROUP BY GROUPING SETS ((configuration), (platform), ())""",
    "median_stage_time": f"""WITH {_ANALYTICS}
SELECT workload_name, configuration, cu_per_second, stage_name,
       median(stage_time_delta) AS median_stage_time
FROM analytics WHERE stage_name NOT IN ('setup') GROUP BY ALL""",
    "average_cost": f"""WITH {_RUN_TOTALS}
SELECT {_CONFIG},
       CAST(sum(ms * cu_per_second) AS DOUBLE) / (count(ms) * 1000.0) AS average_cost
FROM totals GROUP BY {_CONFIG}""",
    "median_cost": f"""WITH {_RUN_TOTALS}
SELECT {_CONFIG}, median(ms * cu_per_second / 1000.0) AS median_cost
FROM totals GROUP BY {_CONFIG}""",
    "measures_by_context": f"""WITH {_RUN_TOTALS}
SELECT CASE WHEN grouping(cu_per_second) = 0 THEN '{_CONFIG.replace(" ", "")}'
            WHEN grouping(configuration) = 0 THEN 'platform,configuration'
            WHEN grouping(workload_name) = 0 THEN 'workload_name'
            WHEN grouping(platform) = 0 THEN 'platform' ELSE '' END AS context,
       {_CONFIG}, count(DISTINCT run_timestamp) AS run_count,
       CAST(sum(ms) AS DOUBLE) / 1000.0 AS total_time,
       CAST(sum(ms) AS DOUBLE) / (count(ms) * 1000.0) AS average_time,
       median(ms / 1000.0) AS median_time,
       CAST(sum(ms * cu_per_second) AS DOUBLE) / (count(ms) * 1000.0) AS average_cost,
       median(ms * cu_per_second / 1000.0) AS median_cost
FROM totals
GROUP BY GROUPING SETS (({_CONFIG}), (platform, configuration), (workload_name), (platform), ())""",
    "time_cost_scatter": f"""WITH {_RUN_TOTALS}
SELECT platform, workload_name, configuration, median(ms / 1000.0) AS median_time,
       median(ms * cu_per_second / 1000.0) AS median_cost,
       count(DISTINCT run_timestamp) AS run_count
FROM totals_without_setup GROUP BY platform, workload_name, configuration""",
}


# The report builds its tables from the stored analytics table.
_REPORT_TABLES = {
    "provisioning": "provisioning_median",
    "default_environments": "default_environments",
    "fastest": "fastest_10",
    "cheapest": "cheapest_10",
    "elapsed_vs_cost": "elapsed_vs_cost",
    "execution_vs_cost": "execution_vs_cost",
    "cumulative": "stage_cumulative_median",
}


def oracle_sql() -> dict[str, str]:
    reports = {f"report_{name}": _RUN_QUERIES[same] for name, same in _REPORT_TABLES.items()}
    return {**_PRICE_QUERIES, **_RUN_QUERIES, **reports}
