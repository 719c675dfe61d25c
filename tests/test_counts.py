"""Reports from stored counts against the same reports from rows."""

from datetime import datetime, timedelta

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from weirlog.operators import filters, incidents, metrics
from weirlog.plans import contexts
from weirlog.sources import tables

REPORTS = [
    metrics.error_rate,
    metrics.percentiles,
    metrics.kpis,
    metrics.latency_trend,
    metrics.endpoint_performance,
    metrics.release_performance,
    metrics.region_performance,
    metrics.service_summary,
    metrics.service_detail,
    metrics.service_breakdown,
    metrics.endpoint_breakdown,
    metrics.endpoint_detail,
    metrics.endpoint_trend,
    metrics.regions_list,
    metrics.plain_error_rate_by_endpoint,
    metrics.plain_daily_latency,
    metrics.plain_release_performance,
    incidents.detect,
    contexts.summary_contexts,
    contexts.service_contexts,
    contexts.chat_context,
]


@pytest.fixture(scope="module")
def store(spark, logs, tmp_path_factory):
    folder = tmp_path_factory.mktemp("counts")
    made = tables.LogTables(spark, "db_counts", str(folder / "db"))
    made.persist_clean(logs.where("year(timestamp) < 1996"), "early", "n", "f.csv")
    made.persist_clean(logs.where("year(timestamp) >= 1996"), "late", "n", "f.csv")
    yield made
    spark.sql(f"DROP DATABASE {made.database} CASCADE")


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("report", REPORTS, ids=lambda r: r.__name__)
def test_reports_from_counts_equal_those_from_rows(store, logs, report):
    counted = report(store.counts())
    assert rows_of(counted) == rows_of(report(logs))


@pytest.mark.parametrize("report", [metrics.latency_trend, metrics.endpoint_performance, metrics.kpis])
def test_reports_read_no_logs(store, report):
    plan = plan_of(report(store.counts("early", service="order-service")))
    assert "log_counts" in plan and "api_logs" not in plan
    assert "dataset_id" in plan.split("PartitionFilters:")[1].split("PushedFilters:")[0]


def test_reports_kept_in_between_read_no_logs(spark, store, monkeypatch):
    """The first step of these is computed at once: its plan is caught where it is kept."""
    plans = []

    def caught(frame):
        plans.append(plan_of(frame))
        return frame

    monkeypatch.setattr(metrics, "durable", caught)
    monkeypatch.setattr(incidents, "durable", caught)
    metrics.service_detail(store.counts())
    incidents.detect(store.counts())
    assert len(plans) == 2 and all("log_counts" in p and "api_logs" not in p for p in plans)


@pytest.mark.parametrize("report", [metrics.overview, metrics.period_comparison, incidents.detect_in_later_half])
def test_halves(store, logs, report):
    assert rows_of(report(store.counts(halves=True))) == rows_of(report(logs))
    one = filters.filter_logs(logs, service="user-service", release="v1.1")
    assert rows_of(report(store.counts(service="user-service", release="v1.1", halves=True))) == rows_of(report(one))


def test_instants_inside_a_day(spark, store, make_logs):
    """Counts of a day that an instant cuts are made from the rows of that day, and of no other."""
    start = datetime(2024, 3, 1)
    rows = [
        {"timestamp": start + timedelta(hours=7 * i, microseconds=i), "response_time_ms": i % 5 + 1, "service_name": f"s{i % 2}",
         "status_code": 500 if i % 3 == 0 else 200}
        for i in range(90)
    ]
    # One count holds rows of both sides.
    rows += [{"timestamp": start + timedelta(days=4, hours=h)} for h in range(24)]
    logs = make_logs(*rows)
    store.persist_clean(logs, "cut", "n", "f.csv")
    try:
        day = start + timedelta(days=4)
        bounds = [(day, None), (day + timedelta(hours=3), None), (None, day), (None, day + timedelta(hours=3)),
                  (day + timedelta(hours=3), day + timedelta(hours=20)), (day + timedelta(hours=5), day + timedelta(hours=5)),
                  (start + timedelta(days=2, hours=7), start + timedelta(days=9, hours=1)), (None, None)]
        for since, until in bounds:
            own = logs.where((F.col("timestamp") >= F.lit(since or start)) & (F.col("timestamp") <= F.lit(until or datetime(2025, 1, 1))))
            found = store.counts("cut", since, until)
            assert rows_of(metrics.kpis(found, "service_name")) == rows_of(metrics.kpis(own, "service_name")), (since, until)
            found = store.counts("cut", since, until, halves=True)
            assert rows_of(metrics.overview(found)) == rows_of(metrics.overview(own)), (since, until)
        whole = plan_of(metrics.kpis(store.counts("cut", day, day + timedelta(days=1) - timedelta(microseconds=1))))
        assert "api_logs" not in whole
        spark.conf.set("spark.sql.maxMetadataStringLength", "3000")
        cut = plan_of(metrics.kpis(store.counts("cut", day + timedelta(hours=3))))
        scan = cut.split(".api_logs[")[1].split("ReadSchema")[0]
        assert "log_month" in scan and "GreaterThanOrEqual(timestamp,2024-03-05T00:00" in scan and "LessThan(timestamp,2024-03-06T00:00" in scan
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
        store.delete_dataset("cut")


def test_counts_go_with_their_dataset(store, logs):
    year = logs.where("year(timestamp) = 1996")
    store.persist_clean(logs.where("year(timestamp) = 1995"), "moving", "n", "f.csv")
    store.persist_clean(year, "moving", "n", "f.csv")
    assert store.counts("moving").agg(F.sum("n")).first()[0] == year.count()
    assert rows_of(metrics.kpis(store.counts("moving"))) == rows_of(metrics.kpis(year))
    store.persist_clean(logs.limit(0), "moving", "n", "f.csv")
    assert store.counts("moving").count() == 0
    assert rows_of(metrics.overview(store.counts("moving", halves=True))) == rows_of(metrics.overview(logs.limit(0)))
    store.delete_dataset("moving")
    assert store._table("log_counts").where("dataset_id = 'moving'").count() == 0


def test_counts_of_a_failed_load_are_not_seen(store, logs, monkeypatch):
    written, before = store._replace_dataset, store.counts().agg(F.sum("n")).first()[0]

    def fail_to_register(frame, table, dataset_id):
        if table == "datasets":
            raise OSError("lost")
        written(frame, table, dataset_id)

    monkeypatch.setattr(store, "_replace_dataset", fail_to_register)
    with pytest.raises(OSError):
        store.persist_clean(logs, "bad", "n", "f.csv")
    assert store.counts("bad").count() == 0 and store.counts().agg(F.sum("n")).first()[0] == before


def test_many_requests_make_few_counts(spark, store, make_logs):
    base = make_logs({"response_time_ms": 5}, {"response_time_ms": 9, "status_code": 503})
    many = base.crossJoin(spark.range(500)).drop("id")
    store.persist_clean(many, "many", "n", "f.csv")
    try:
        counts = store.counts("many")
        assert counts.count() == 2
        assert rows_of(metrics.kpis(counts)) == rows_of(metrics.kpis(many))
    finally:
        store.delete_dataset("many")
