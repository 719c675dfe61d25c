from datetime import datetime

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from weirlog.operators import explore


def test_pages_cover_every_row_once(logs):
    part = logs.where("service_name = 'auth-service' AND release_version = 'v1.0'")
    expected = [tuple(r) for r in part.orderBy(F.col("timestamp").desc(), *part.columns[1:]).collect()]
    seen, page = [], 1
    while rows := explore.log_page(part, page, 200).collect():
        assert {r.total for r in rows} == {len(expected)}
        seen += [tuple(r)[:-1] for r in rows]
        page += 1
    assert seen == expected


@pytest.mark.parametrize("with_id", [False, True])
def test_far_pages_are_found_by_counting(logs, make_logs, monkeypatch, with_id):
    same = [{"timestamp": datetime(2024, 5, 1, 12, 0, 0, 1500), "response_time_ms": i} for i in range(300)]
    near = [{"timestamp": datetime(2024, 5, 1, 12, 0, 1, i), "response_time_ms": i} for i in range(100)]
    rows = logs.unionByName(make_logs(*same, *near).withColumn("response_time_ms", F.col("response_time_ms") + 1))
    rows = explore.with_log_id(rows) if with_id else rows
    plain = {p: explore.log_page(rows, p, 50).collect() for p in (1, 3, 5, 8, 128)}
    monkeypatch.setattr(explore, "SEEK_FROM_ROW", 20)
    for page, expected in plain.items():
        assert explore.log_page(rows, page, 50).collect() == expected, page


def test_next_page_by_key(logs):
    rows = explore.with_log_id(logs)
    first, second = explore.log_page(rows, 1, 30).collect(), explore.log_page(rows, 2, 30).drop("total").collect()
    assert explore.log_page_after(rows, first[-1].timestamp, first[-1].log_id, 30).collect() == second


def test_ids_are_distinct_and_found(logs):
    rows = explore.with_log_id(logs, "ds")
    assert rows.select("log_id").distinct().count() == logs.distinct().count()
    assert {len(r.log_id) for r in rows.limit(5).collect()} == {32}
    wanted = rows.first()
    assert explore.log_get(rows, wanted.log_id).first().timestamp == wanted.timestamp
    with pytest.raises(LookupError):
        explore.require_rows(explore.log_get(rows, "none"), "log")
    assert explore.require_rows(rows, "log") is rows


def test_a_far_page_is_a_bound_on_the_timestamp(logs, tmp_path, spark, monkeypatch):
    logs.write.parquet(f"{tmp_path}/logs")
    monkeypatch.setattr(explore, "SEEK_FROM_ROW", 20)
    plan = explore.log_page(spark.read.parquet(f"{tmp_path}/logs"), 100, 10)._jdf.queryExecution().executedPlan().toString()
    pushed = [scan.split("ReadSchema")[0] for scan in plan.split("PushedFilters:")[1:]]
    assert any("GreaterThanOrEqual(timestamp" in p and "LessThan(timestamp" in p for p in pushed), pushed


def test_page_limits(logs):
    for page, limit in ((0, 10), (1, 0), (1, 501)):
        with pytest.raises(ValueError):
            explore.log_page(logs, page, limit)
    assert explore.page_count(logs.where("false")).first()[0] == 1
    assert explore.page_count(logs.limit(26)).first()[0] == 2


def test_walking_by_cursor_equals_pages_by_number(logs):
    rows = explore.with_log_id(logs.distinct())
    page = None
    for number in range(1, 6):
        page = explore.next_page(rows, page, limit=40)
        assert rows_of(page) == rows_of(explore.log_page(rows, number, 40).drop("total")), number
    few = rows.limit(50).persist()
    first = explore.next_page(few, None, 40)
    second = explore.next_page(few, first, 40)
    assert (first.count(), second.count(), explore.next_page(few, second, 40).count()) == (40, 10, 0)
    assert explore.next_page(few, explore.next_page(few, second, 40), 40).count() == 0
