import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from weirlog.operators import cleaning, quality
from weirlog.schema import LOG_COLUMNS


@pytest.mark.parametrize(
    "endpoint, expected",
    [("/", "/"), ("//", ""), (" /Login/ ", "/login"), ("/a/b///", "/a/b"), ("\t/X\t", "/x"), (" /y ", "/y"),
     (None, "unknown-endpoint"), ("", "unknown-endpoint"), ("   ", "unknown-endpoint")],
)
def test_endpoint(make_raw, endpoint, expected):
    assert cleaning.clean(make_raw({"endpoint": endpoint})).first().endpoint == expected


@pytest.mark.parametrize(
    "status, kept",
    [("199", None), ("600", None), ("599.5", None), ("abc", None), (None, None), ("NaN", None), ("200d", None),
     ("200", 200), ("599", 599), ("200.7", 200), (" 201 ", 201)],
)
def test_status(make_raw, status, kept):
    row = cleaning.clean(make_raw({"status_code": status})).first()
    assert (row and row.status_code) == kept


@pytest.mark.parametrize(
    "latency, kept",
    [("0", None), ("-1", None), (None, None), ("inf", None), ("Infinity", None), ("1e30", None), ("5f", None),
     ("0.5", 0), ("3000000000", 3_000_000_000), ("12.9", 12)],
)
def test_latency(make_raw, latency, kept):
    row = cleaning.clean(make_raw({"response_time_ms": latency})).first()
    assert (row.response_time_ms if row else None) == kept


def test_names_keep_case_and_get_defaults(make_raw):
    row = cleaning.clean(
        make_raw({"service_name": " A ", "release_version": "  ", "server_region": None})
    ).first()
    assert (row.service_name, row.release_version, row.server_region) == ("A", "unknown", "unknown")
    assert cleaning.clean(make_raw({"service_name": "\t"})).first().service_name == "unknown-service"


def test_report_counts_in_order(make_raw):
    raw = make_raw(
        {}, {}, {"endpoint": "/LOGIN/"},  # three copies of one line after normalising
        {"status_code": "999", "response_time_ms": "-1"},  # counted as bad status only
        {"response_time_ms": "-1"},
        {"timestamp": "not-a-date"},  # dropped, not counted
        {"endpoint": None}, {"endpoint": ""}, {"service_name": None},
    )
    assert cleaning.report(raw).first().asDict() == {
        "raw_rows": 9, "clean_rows": 3, "dropped_invalid_status": 1, "dropped_invalid_latency": 1,
        "duplicates_removed": 3, "unknown_endpoint_count": 2, "unknown_service_count": 1,
    }
    counts = cleaning.drop_counts(raw).first()
    assert (counts.raw_rows, counts.usable_rows, counts.unknown_endpoint_count) == (9, 6, 2)


def test_report_of_nothing(make_raw):
    assert set(cleaning.report(make_raw({}).where("false")).first()) == {0}


def test_report_identity(raw):
    report = cleaning.report(raw).first()
    bad_time = cleaning.coerce(raw).where(
        cleaning.valid_status() & cleaning.valid_latency() & ~cleaning.valid_timestamp()
    ).count()
    assert report.raw_rows == (
        report.clean_rows + report.dropped_invalid_status + report.dropped_invalid_latency
        + report.duplicates_removed + bad_time
    )
    assert (report.raw_rows, report.clean_rows) == (1050, 570)


def test_cleaning_is_idempotent(raw):
    once = cleaning.clean(raw)
    again = cleaning.clean(once.select([F.col(c).cast("string").alias(c) for c in LOG_COLUMNS]))
    assert rows_of(once) == rows_of(again)


def test_many_copies_collapse(make_raw):
    copies = make_raw({}).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(5000)))).drop("copy")
    hot = copies.union(make_raw({"endpoint": "/other"}))
    assert cleaning.clean(hot).count() == 2
    assert cleaning.report(hot).first().duplicates_removed == 4999


def test_older_rules(make_raw):
    table = quality.typed(
        make_raw({"service_name": None, "endpoint": " /A/ "}, {"endpoint": None}, {"endpoint": "", "timestamp": "x"})
    )
    first = quality.clean_stage1(table)
    assert {(r.service_name, r.endpoint) for r in first.collect()} == {
        ("unknown_service", "/a/"), ("auth-service", None), ("auth-service", ""),
    }
    second = quality.clean_stage2(first)
    assert second.where("endpoint = 'unknown-endpoint'").count() == 2
    assert quality.unknown_count(second).first()[0] == 2
    assert quality.residual_nulls(second).first()[0] == 0
    assert tuple(quality.null_profile(table).first()) == (1, 2, 0, 0)
