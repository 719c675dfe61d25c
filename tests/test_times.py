"""Timestamps in other formats than ISO."""

from datetime import datetime

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from weirlog.functions.times import DATE_FORMATS, FORMATS, parse_timestamp
from weirlog.operators import cleaning
from weirlog.schema import LOG_COLUMNS
from weirlog.sources import csv_logs, tables

AT = datetime(2024, 12, 31, 10, 5)
TEXTS = {
    "ISO": "2024-12-31T10:05",
    "yyyy/MM/dd": "2024/12/31 10:05",
    "yyyy.MM.dd": "2024.12.31 10:05:00",
    "yyyyMMdd": "20241231 10:05",
    "MM/dd/yyyy": "12/31/2024 10:05 AM",
    "dd/MM/yyyy": "31/12/2024 10:05",
    "MM-dd-yyyy": "12-31-2024 10:05:00.000",
    "dd-MM-yyyy": " 31-12-2024 10:05 ",
    "MM.dd.yyyy": "12.31.2024 10:05am",
    "dd.MM.yyyy": "31.12.2024, 10:05",
    "dd MMM yyyy": "31 dec 2024 10:05",
    "MMM dd, yyyy": "Dec 31, 2024 10:05 AM",
    "dd/MMM/yyyy": "31/Dec/2024:10:05:00",
}


def parsed(spark, texts, name):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = rows.select("i", parse_timestamp(F.col("t"), name).alias("at")).orderBy("i")
    assert found.schema["at"].dataType.typeName() == "timestamp_ntz"
    return [r["at"] for r in found.collect()]


def test_each_format_reads_its_own_text(spark):
    assert set(TEXTS) == set(FORMATS)
    for name, text in TEXTS.items():
        assert parsed(spark, [text, None, "", "x", text + "x"], name) == [AT, None, None, None, None], name


def test_days_and_times_that_there_are_not(spark):
    texts = ["31/04/2024", "29/02/2023", "29/02/2024", "12/13/2024", "01/01/2024 24:00", "01/01/2024 23:59:59.5", "1/2/2024 9:07"]
    assert parsed(spark, texts, "dd/MM/yyyy") == [
        None, None, datetime(2024, 2, 29), None, None, datetime(2024, 1, 1, 23, 59, 59, 500_000), datetime(2024, 2, 1, 9, 7)
    ]
    texts = ["1/2/2024 12:30 AM", "1/2/2024 12:30 PM", "1/2/2024 1:30:05 pm", "1/2/2024 13:30 PM", "1/2/2024 0:30 AM", "1/2/2024 13:30"]
    assert parsed(spark, texts, "MM/dd/yyyy") == [
        datetime(2024, 1, 2, 0, 30), datetime(2024, 1, 2, 12, 30), datetime(2024, 1, 2, 13, 30, 5), None, None, datetime(2024, 1, 2, 13, 30)
    ]
    assert parsed(spark, ["31 Foo 2024", "31 anf 2024", "1 sep 2024"], "dd MMM yyyy") == [None, None, datetime(2024, 9, 1)]


def test_zone_of_the_session_does_not_matter(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:  # an hour that this zone skips
        assert parsed(spark, ["10/03/2024 02:30"], "dd/MM/yyyy") == [datetime(2024, 3, 10, 2, 30)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_unknown_format(spark):
    with pytest.raises(ValueError, match="dd/MM/yyyy"):
        parse_timestamp(F.lit("x"), "yy-MM")


@pytest.mark.parametrize(
    "texts, used",
    [
        (["31/12/2024 10:00", "01/02/2024"], "dd/MM/yyyy"),
        (["01/02/2024", "31/12/2024", "30/12/2024"], "MM/dd/yyyy"),  # the first decides, whatever fits more
        ([None, "", "not a date", "31-12-2024", "2024-12-31"], "dd-MM-yyyy"),
        (["2024-12-31", "31/12/2024"], "ISO"),
        ([None, "not a date"], "ISO"),
        ([], "ISO"),
    ],
)
def test_the_first_value_decides(make_raw, texts, used):
    raw = make_raw(*({"timestamp": t} for t in texts)) if texts else make_raw({}).limit(0)
    assert cleaning.infer_timestamp_format(raw) == used


def test_counts_of_formats(make_raw):
    raw = make_raw(*({"timestamp": t} for t in ["01/02/2024", "31/12/2024", "2024-01-01", "x", None, "12/31/2024"])).repartition(1)
    found = {r.format: (r.n_values, r.is_used) for r in cleaning.timestamp_formats(raw).collect()}
    assert set(found) == set(FORMATS)
    assert found["ISO"][0] == 1 and found["MM/dd/yyyy"][0] == 2 and found["dd/MM/yyyy"][0] == 2
    assert sum(used for _, used in found.values()) == 1 and sum(n for n, _ in found.values()) == 5


def test_first_in_the_file_and_not_in_a_partition(spark, make_raw, tmp_path):
    """Many splits of one file, and several files: the first line of the first file decides."""
    rows = [{"timestamp": "31/12/2024 10:00"}] + [{"timestamp": f"{i % 12 + 1:02d}/{i % 12 + 1:02d}/2024 10:00"} for i in range(5000)]
    make_raw(*rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "raw"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        path = str(tmp_path / "logs")
        csv_logs.write_raw_csv(make_raw(*rows).coalesce(1), path)
        raw = csv_logs.read_raw_csv(spark, path)
        assert raw.rdd.getNumPartitions() > 8
        assert cleaning.infer_timestamp_format(raw) == "dd/MM/yyyy"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_day_first_file_is_loaded_whole(spark, raw, tmp_path):
    """A file with day-first dates gives the same clean rows as the same file in ISO."""
    store = tables.LogTables(spark, "db_times", str(tmp_path / "db"))
    try:
        iso = raw.where("timestamp LIKE '____-__-__ %'").orderBy(F.substring("timestamp", 9, 2).desc(), "timestamp").coalesce(1)
        swapped = F.regexp_replace("timestamp", r"^(\d{4})-(\d\d)-(\d\d)", "$3/$2/$1")
        csv_logs.write_raw_csv(iso.withColumn("timestamp", swapped), str(tmp_path / "day_first.csv"))
        counted = store.ingest(str(tmp_path / "day_first.csv"), "day first").first()
        expected = cleaning.report(iso).first()
        assert counted.clean_rows == expected.clean_rows > 0 and counted.duplicates_removed == expected.duplicates_removed
        assert rows_of(store.scan().select(*LOG_COLUMNS)) == rows_of(cleaning.clean(iso))
        wrong = store.ingest(str(tmp_path / "day_first.csv"), "as ISO", timestamp_format="ISO").first()
        assert wrong.clean_rows == 0
    finally:
        spark.sql("DROP DATABASE db_times CASCADE")


def test_iso_columns_are_read_as_before(raw):
    assert cleaning.infer_timestamp_format(raw) == "ISO"
    assert rows_of(cleaning.coerce(raw)) == rows_of(cleaning.coerce(raw, "ISO"))
    assert all(shape and len(parts) == 3 for shape, parts in DATE_FORMATS.values())
