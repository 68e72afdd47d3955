"""Ingest, cleaning, star schema and summaries on rows made by hand."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from housemark import schemas
from housemark.functions.prices import decode, decode_by_map, postcode_area
from housemark.operators import star_schema, summaries
from housemark.plans import price_jobs, views
from housemark.sources import price_files

LINES = [
    '"{A}","100","2025-01-05 00:00","SW1 1AA","D","Y","F","1","","HIGH ST","","LONDON","WEST","GREATER","A","A"',
    '"{B}","notanum","2025-02-30 00:00","","X","N","F","The ""Old"" Barn, 2","","","","LEEDS","N","YORK","A","A"',
    '"{C}","250.5","bad","9ZZ 1AA","O","?","F","","","","","","","","B","A"',
    '{D},7,2025-03-01 12:30,b1 1aa,,,,,,,,,,,,',
]


@pytest.fixture
def raw(spark, path):
    spark.createDataFrame([(line,) for line in LINES], "value string").coalesce(1).write.text(path)
    return price_files.read_price_paid(spark, path)


def prices_frame(spark, rows):
    return spark.createDataFrame(
        [(p, d, None, None, kind, None) for p, d, kind in rows], schemas.PRICES
    )


def calendar(prices):
    return star_schema.with_month_tag(star_schema.dates_dim(star_schema.date_bounds(prices)))


def test_bad_values_become_null_and_quotes_survive(raw):
    rows = {r.transaction_unique_identifier: r for r in raw.collect()}
    assert rows["{A}"].price == 100.0
    assert rows["{A}"].date_of_transfer == datetime(2025, 1, 5)
    assert rows["{A}"].saon is None
    assert rows["{B}"].price is None
    assert rows["{B}"].date_of_transfer is None
    assert rows["{B}"].postcode is None
    assert rows["{B}"].paon == 'The "Old" Barn, 2'
    assert rows["{C}"].date_of_transfer is None
    assert rows["{D}"].date_of_transfer == datetime(2025, 3, 1, 12, 30)
    assert rows["{D}"].county is None


def test_written_files_read_back_unchanged(spark, raw, store):
    target = store.path("again")
    price_files.write_price_paid(raw, target)
    again = price_files.read_price_paid(spark, target)
    assert sorted(map(str, again.collect())) == sorted(map(str, raw.collect()))


def test_projection_prunes_the_scan(spark, raw, store):
    price_files.write_price_paid(raw, store.path("raw"))
    few = price_files.read_price_paid(spark, store.path("raw"), ["price"])
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<price:double>" in plan


def test_clean(raw):
    rows = {r.price: r for r in star_schema.clean_price_paid(raw).collect()}
    assert list(rows[100.0].asDict()) == schemas.CLEAN_COLUMNS
    assert (rows[100.0].property_type, rows[100.0].old_new) == ("Detached", "New")
    assert rows[100.0].date_of_transfer == date(2025, 1, 5)
    assert rows[100.0].postcode_area == "SW"
    assert (rows[None].property_type, rows[None].old_new) == ("X", "Old")
    assert rows[None].postcode_area is None  # NULL postcode
    assert (rows[250.5].property_type, rows[250.5].old_new) == ("Other", "?")
    assert rows[250.5].postcode_area == ""  # no leading capital
    assert rows[7.0].property_type is None


def test_postcode_without_match_on_request_null(spark):
    frame = spark.createDataFrame([("9ZZ",), ("B1",), ("ABC",), (None,)], "p string")
    found = frame.select(
        postcode_area(F.col("p")), postcode_area(F.col("p"), no_match_as_null=True)
    ).collect()
    assert [tuple(r) for r in found] == [("", None), ("B", "B"), ("AB", "AB"), (None, None)]


def test_both_decoders_agree(spark):
    frame = spark.createDataFrame([(c,) for c in [*"DSTFOX", "", None]], "c string")
    code = F.col("c")
    rows = frame.select(
        decode(code, schemas.PROPERTY_TYPES), decode_by_map(code, schemas.PROPERTY_TYPES)
    ).collect()
    assert all(a == b for a, b in rows)
    assert [a for a, _ in rows][-3:] == ["X", "", None]


def test_dates_have_no_gaps_and_sunday_is_zero(spark):
    prices = prices_frame(spark, [(1.0, date(2024, 2, 27), "A"), (2.0, date(2024, 3, 3), "A")])
    rows = calendar(prices).orderBy("date").collect()
    assert [r.date.day for r in rows] == [27, 28, 29, 1, 2, 3]
    assert (rows[-1].weekday, rows[-1].weekday_name) == (0, "Sunday")
    assert (rows[2].month_name, rows[2].day_of_year, rows[2].month_tag) == ("February", 60, "2024_02")


def test_one_date_and_no_dates(spark):
    assert calendar(prices_frame(spark, [(1.0, date(2024, 2, 27), "A")])).count() == 1
    assert calendar(prices_frame(spark, [])).count() == 0


def test_locations_are_distinct_with_nulls(spark):
    rows = [(None,) * 6 + ("T", "D", "C"), (None,) * 9, (None,) * 6 + ("T", "D", "C"), (None,) * 9]
    clean = spark.createDataFrame(
        rows,
        "price double, date_of_transfer date, postcode string, postcode_area string, "
        "property_type string, old_new string, town_city string, district string, county string",
    )
    assert star_schema.locations_dim(clean).count() == 2


def test_filter_rejects_other_and_null(spark):
    rows = [(1.0, date(2024, 1, 1), kind) for kind in ("Other", None, "X")]
    kept = star_schema.without_other(prices_frame(spark, rows)).collect()
    assert [r.property_type for r in kept] == ["X"]


def test_join_keeps_rows_without_a_date(spark):
    prices = prices_frame(spark, [(1.0, date(2024, 1, 1), "A"), (2.0, None, "A")])
    joined = summaries.join_dates(prices, calendar(prices))
    assert joined.columns == [*schemas.PRICES.fieldNames(), "month_tag"]
    assert {r.price: r.month_tag for r in joined.collect()} == {1.0: "2024_01", 2.0: None}


def test_monthly_summary(spark):
    day, later = date(2024, 1, 1), date(2024, 2, 1)
    rows = [(p, day, "A") for p in (1.0, 2.0, 3.0, 10.0, None)]
    rows += [(5.0, later, "A"), (None, later, "B"), (4.0, None, "A")]
    prices = prices_frame(spark, rows)
    joined = summaries.join_dates(prices, calendar(prices))

    found = [tuple(r) for r in summaries.monthly_summary(joined).collect()]
    assert found == [
        ("2024_01", "A", 5, 2.5, 1.0, 10.0),
        ("2024_02", "A", 1, 5.0, 5.0, 5.0),
        ("2024_02", "B", 1, None, None, None),
        (None, "A", 1, 4.0, 4.0, 4.0),
    ]
    counted = summaries.monthly_summary(joined, count_nulls=False).collect()
    assert [r.number_of_transactions for r in counted] == [4, 1, 0, 1]
    approx = summaries.monthly_summary_approx(joined).collect()
    assert approx[0].median_price == 2.0


def test_recent_summary_labels_the_month(spark, raw):
    rows = [(2015, 1, "D"), (2016, 3, "D"), (2016, 11, "O"), (2017, 12, None)]
    summary = spark.createDataFrame(rows, "year int, month_number int, property_type string")
    assert [r.year_month for r in summaries.recent_summary(summary).collect()] == ["2016_03"]


def test_preview_puts_nulls_last(spark):
    frame = spark.createDataFrame([(None,), (2,), (1,)], "a int")
    assert [r.a for r in summaries.preview(frame, ["a"], 2).collect()] == [1, 2]


def test_sample_has_the_asked_size(spark):
    frame = spark.range(100)
    assert summaries.sample_rows(frame, 5).distinct().count() == 5
    assert summaries.sample_rows(frame, 500).count() == 100


def test_union_matches_names(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    b = spark.createDataFrame([("y", 2)], "s string, n int")
    assert sorted(map(tuple, price_files.union_frames([a, b]).collect())) == [(1, "x"), (2, "y")]


def test_inventory(spark, path):
    spark.createDataFrame([("abc",)], "v string").coalesce(1).write.text(path)
    row = price_files.inventory(spark, f"{path}/*.txt").collect()[0]
    assert row.file_count == 1
    assert row.total_gib == 4 / (1 << 30)


def test_files_to_summary(spark, raw, store):
    price_files.write_price_paid(raw, store.path("raw"))
    summary = price_jobs.files_to_summary(spark, store.path("raw"), store)
    assert [tuple(r) for r in summary.collect()] == [
        ("2025_01", "Detached", 1, 100.0, 100.0, 100.0),
        (None, "X", 1, None, None, None),
    ]
    # Calendar from the first to the last known date.
    assert store.read("dates").count() == 56
    assert store.read("locations").count() == 3  # two rows have none
    approx = price_jobs.files_to_summary(spark, store.path("raw"), store, approximate=True)
    assert approx.count() == 2


def test_sql_over_views(spark, raw, store):
    price_files.write_price_paid(raw, store.path("raw"))
    price_jobs.files_to_summary(spark, store.path("raw"), store)
    views.register_files(raw)
    views.register_star_schema(store)
    assert spark.sql("SELECT count(*) FROM price_paid_raw JOIN price_paid_data USING (price)").first()[0] == 3
    found = spark.sql(
        "SELECT month_tag, count(*) AS n, max(price) AS top FROM prices "
        "LEFT JOIN dates ON date_of_transfer = date GROUP BY month_tag ORDER BY month_tag"
    )
    assert [tuple(r) for r in found.collect()] == [(None, 2, 250.5), ("2025_01", 1, 100.0), ("2025_03", 1, 7.0)]
    assert spark.table("locations").count() == 3


def test_transactions_add_up(spark, store):
    rows = [(float(i % 7), date(2024, 1 + i % 12, 1 + i % 28), "AB"[i % 2]) for i in range(500)]
    prices = prices_frame(spark, rows)
    joined = summaries.join_dates(prices, calendar(prices))
    assert joined.count() == 500
    summary = summaries.monthly_summary(joined)
    assert summary.agg(F.sum("number_of_transactions")).collect()[0][0] == 500
