"""Lines that an ingest cannot read, and their counts."""

import pytest

from housemark.operators import rejects
from housemark.plans import price_jobs
from housemark.schemas import PRICE_PAID_RAW
from housemark.sources import price_files

ROW = ["id", "10", "2020-01-05 00:00", "AB1 2CD", "D", "Y", "F", "p", "", "s", "l", "t", "d", "c", "A", "A"]


def line(**changed):
    values = dict(zip(PRICE_PAID_RAW.fieldNames(), ROW)) | changed
    return ",".join('"' + v.replace('"', '""') + '"' for v in values.values())


@pytest.fixture
def ingest(spark, store, path):
    def run(lines):
        spark.createDataFrame([(x,) for x in lines], "value string").repartition(2).write.text(path)
        clean = price_jobs.ingest_with_rejects(spark, path, store)
        counts = {r.column_name: tuple(r)[1:] for r in store.read("reject_counts").collect()}
        return clean, counts, store.read("rejected_lines")

    return run


def test_each_kind_of_reject(ingest):
    lines = [
        line(),
        line(price=""),
        line(price="notanum"),
        line(date_of_transfer="2025-02-30 00:00"),
        line(price="x", date_of_transfer="bad"),
        line().rsplit(",", 3)[0],
        line() + ',"more"',
        line(price="1e3", paon='The "Old" House, 1', date_of_transfer="bad"),
    ]
    clean, counts, rejected = ingest(lines)
    assert counts == {
        "price": (8, 5, 2),
        "date_of_transfer": (8, 5, 3),
        "number_of_fields": (8, 6, 2),
    }
    found = {r.rejected_line: (r.failed_columns, r.texts) for r in rejected.collect()}
    assert set(found) == set(lines[2:])
    assert found[lines[4]][0] == ["price", "date_of_transfer"]
    assert found[lines[5]][0] == found[lines[6]][0] == ["number_of_fields"]
    assert found[lines[7]][1].paon == 'The "Old" House, 1'
    assert found[lines[2]][1].price == "notanum"
    assert clean.count() == 8
    assert sorted(r.price for r in clean.where("price IS NOT NULL").collect()) == [10, 10, 10, 10, 1000]


def test_nothing_rejected_and_nothing_at_all(spark, ingest):
    _, counts, rejected = ingest([line()])
    assert counts["price"] == (1, 1, 0) and rejected.count() == 0


def test_no_lines(ingest):
    clean, counts, rejected = ingest([])
    assert clean.count() == 0 and rejected.count() == 0
    assert counts == {c: (0, 0, 0) for c in ("price", "date_of_transfer", "number_of_fields")}


def test_values_equal_those_of_the_plain_reader(spark, path):
    lines = [line(price=p, date_of_transfer=d) for p in ("1", "", "x") for d in ("2020-01-01 10:30", "y", "")]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    plain = price_files.read_price_paid(spark, path)
    kept = price_files.read_with_rejects(spark, path).drop(rejects.LINE)
    assert sorted(map(str, kept.collect())) == sorted(map(str, plain.collect()))


def test_the_text_is_parsed_once(spark, path, monkeypatch, store):
    spark.createDataFrame([(line(),)], "value string").write.text(path)
    reads = []
    read = price_jobs.read_with_rejects
    monkeypatch.setattr(price_jobs, "read_with_rejects", lambda *a: reads.append(a) or read(*a))
    clean = price_jobs.ingest_with_rejects(spark, path, store)
    assert len(reads) == 1 and "FileScan parquet" in clean._jdf.queryExecution().executedPlan().toString()
