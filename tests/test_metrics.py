import re
from datetime import datetime

import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from weirlog.operators import compare, filters, metrics, outliers, scores


def test_empty_log(logs):
    empty = logs.where("false")
    row = metrics.overview(empty).first().asDict()
    assert row.pop("availability_percent") == 100.0
    assert set(row.values()) == {0}
    assert metrics.percentiles(empty).first().asDict() == dict.fromkeys(("avg", "p50", "p95", "p99", "max"), 0.0)
    for table in (
        metrics.latency_trend, metrics.endpoint_performance, metrics.release_performance, metrics.region_performance,
        metrics.service_summary, metrics.service_detail, metrics.service_breakdown, compare.top_bucket,
    ):
        assert table(empty).count() == 0
    for method in outliers.METHODS:
        assert outliers.outliers(empty, method).count() == 0


def test_percentiles_match_linear_interpolation(make_logs):
    values = [3, 9, 1, 250, 17, 17, 4, 88, 1200, 5]
    row = metrics.percentiles(make_logs(*[{"response_time_ms": v} for v in values])).first()
    for name, q in (("p50", 50), ("p95", 95), ("p99", 99)):
        assert row[name] == pytest.approx(np.percentile(values, q), abs=1e-9)
    assert (row["avg"], row["max"]) == (np.mean(values), 1200.0)


def test_kpis(make_logs):
    logs = make_logs(
        {"response_time_ms": 1000}, {"response_time_ms": 1001, "status_code": 404},
        {"status_code": 503, "service_name": "unknown-service"}, {"status_code": 399},
    )
    row = metrics.kpis(logs).first()
    assert (row.total_requests, row.slow_requests, row.active_services, row.failed_requests) == (4, 1, 2, 2)
    assert (row.error_rate_percent, row.error_rate_4xx_percent, row.error_rate_5xx_percent) == (50.0, 25.0, 25.0)
    assert metrics.kpis(logs, slow_threshold_ms=99).first().slow_requests == 4


def test_period_comparison(make_logs):
    one_instant = {"timestamp": datetime(2024, 1, 1)}
    same = metrics.period_comparison(make_logs(one_instant, {**one_instant, "response_time_ms": 900})).first()
    assert tuple(same) == (0.0, 0.0)
    # A row exactly at the middle belongs to the later half.
    rows = [
        {"timestamp": datetime(2024, 1, 1, 0), "response_time_ms": 100},
        {"timestamp": datetime(2024, 1, 1, 1), "response_time_ms": 150, "status_code": 500},
        {"timestamp": datetime(2024, 1, 1, 2), "response_time_ms": 250},
    ]
    assert tuple(metrics.period_comparison(make_logs(*rows)).first()) == (50.0, 100.0)
    odd = [
        {"timestamp": datetime(2024, 1, 1, 0, 0, 0, 0), "response_time_ms": 100},
        {"timestamp": datetime(2024, 1, 1, 0, 0, 0, 1), "response_time_ms": 200},
    ]
    assert tuple(metrics.period_comparison(make_logs(*odd)).first()) == (0.0, 100.0)


def test_requests_add_up_in_every_dimension(logs):
    total = logs.count()
    for table in (metrics.endpoint_performance, metrics.release_performance, metrics.region_performance):
        assert table(logs).agg({"requests": "sum"}).first()[0] == total
    parts = metrics.service_breakdown(logs).groupBy("dimension").sum("requests").collect()
    assert len(parts) == 3 and {r[1] for r in parts} == {total}


def test_breakdown_equals_separate_tables(logs):
    one = logs.where("service_name = 'order-service'")
    parts = metrics.service_breakdown(logs).where("service_name = 'order-service'")
    names = ["requests", "avg_latency_ms", "p95_latency_ms", "p99_latency_ms", "error_rate_percent"]
    endpoints = parts.where("dimension = 'endpoint'").select("value", *names, "status")
    assert rows_of(endpoints) == rows_of(metrics.endpoint_performance(one).drop("service_name"))
    releases = parts.where("dimension = 'release_version'").select("value", *names)
    assert rows_of(releases) == rows_of(metrics.release_performance(one))


def test_endpoint_detail_takes_first_service(make_logs):
    logs = make_logs(
        {"service_name": "b", "response_time_ms": 900, "status_code": 500}, {"service_name": "a"},
        {"service_name": "b", "status_code": 404},
    )
    row = metrics.endpoint_detail(logs).first()
    assert (row.service_name, row.requests, row.max_latency_ms) == ("a", 1, 900.0)
    assert (row.error_rate_4xx_percent, row.error_rate_5xx_percent) == (33.33, 33.33)
    assert metrics.endpoint_detail(logs, by_service=True).count() == 2


def test_filters(logs):
    every = logs.count()
    assert filters.filter_logs(logs, "", None, "", None, "", None, 0).count() == every
    # A bare end date is midnight: the rest of that day is outside.
    day = logs.agg({"timestamp": "max"}).first()[0]
    upto = filters.filter_logs(logs, date_to=day.strftime("%Y-%m-%d"))
    assert upto.count() == logs.where(f"timestamp <= TIMESTAMP_NTZ '{day:%Y-%m-%d}'").count()
    with pytest.raises(ValueError):
        filters.filter_releases(logs, " , ")


def test_search_is_literal(make_logs):
    table = metrics.endpoint_performance(
        make_logs({"endpoint": "/a_b"}, {"endpoint": "/axb"}, {"endpoint": "/c%d"}, {"service_name": "A_B"})
    )
    assert {r.endpoint for r in filters.search_endpoints(table, "A_b").collect()} == {"/a_b", "/login"}
    assert filters.search_endpoints(table, "%").count() == 1


def test_regressions_skip_unknown_names(make_logs):
    logs = make_logs(
        *[{"release_version": r, "response_time_ms": ms} for r, ms in (("v1", 100), ("v3", 130), ("v10", 130))]
    )
    perf = metrics.release_performance(logs)
    rows = {r.release_version: r for r in compare.regressions(perf, "v1,v2,v3").collect()}
    assert set(rows) == {"v1", "v3"}
    assert rows["v1"].previous_release_version is None and not rows["v1"].is_regression
    assert (rows["v3"].previous_release_version, rows["v3"].avg_latency_change_percent) == ("v1", 30.0)
    assert rows["v3"].is_regression
    by_name = {r.release_version: r.previous_release_version for r in compare.regressions_by_name(perf).collect()}
    assert by_name == {"v1": None, "v10": "v1", "v3": "v10"}
    pair = compare.release_pair(perf).collect()
    assert [(r.release_version, r.previous_release_version) for r in pair] == [("v3", "v10")]
    assert compare.release_pair(perf, "v3", "v1").first().avg_latency_change_percent == -23.08
    assert compare.release_pair(perf.where("release_version = 'v1'")).count() == 0
    with pytest.raises(ValueError):
        compare.regressions(perf, "")


@pytest.mark.parametrize("n", [1, 19, 20, 21, 40, 57, 100])
def test_top_bucket_equals_ntile(spark, make_logs, n):
    logs = make_logs(*[{"response_time_ms": (i * 37) % 11 + 1} for i in range(n)])
    logs.createOrReplaceTempView("bucket_logs")
    expected = spark.sql(
        """SELECT endpoint, avg(response_time_ms), max(response_time_ms) FROM (SELECT endpoint, response_time_ms,
           ntile(20) OVER (PARTITION BY endpoint ORDER BY response_time_ms) AS b FROM bucket_logs)
           WHERE b = 20 GROUP BY endpoint"""
    )
    assert rows_of(compare.top_bucket(logs)) == rows_of(expected)


def test_zscores_tell_deviations_apart(make_logs):
    # With 11 rows the largest possible score is 3.015 (sample) or 3.162 (population).
    spiky = make_logs(*[{"response_time_ms": 1}] * 10, {"response_time_ms": 100})
    assert outliers.zscore_outliers(spiky).count() == 1
    ten = make_logs(*[{"response_time_ms": 1}] * 9 + [{"response_time_ms": 2}], {"response_time_ms": 40})
    sample, population = outliers.zscore_outliers(ten).count(), outliers.population_zscore_outliers(ten).count()
    values = np.array([1] * 9 + [2, 40])
    scores_ = [abs(40 - values.mean()) / values.std(ddof=d) for d in (1, 0)]
    assert [sample, population] == [int(s > 3) for s in scores_]
    small = make_logs(*[{"response_time_ms": 1}] * 9, {"response_time_ms": 50}, {"response_time_ms": 5})
    values = np.array([1] * 9 + [50, 5])
    assert outliers.zscore_outliers(small).count() == int(abs(50 - values.mean()) / values.std(ddof=1) > 3)


def test_constant_latency_has_no_outliers(make_logs):
    flat = make_logs(*[{}] * 5)
    for method in outliers.METHODS:
        assert outliers.outliers(flat, method).count() == 0
    assert outliers.population_zscore_outliers(flat).count() == 0
    with pytest.raises(ValueError):
        outliers.outliers(flat, "mad")
    with pytest.raises(ValueError):
        outliers.outlier_page(flat, limit=1001)


def test_endpoint_outliers_with_and_without_broadcast(logs, monkeypatch):
    from weirlog.operators import joins

    small = rows_of(outliers.endpoint_p95_outliers(logs))
    monkeypatch.setattr(outliers, "size_checked", lambda t: joins.size_checked(t, limit_bytes=0))
    assert rows_of(outliers.endpoint_p95_outliers(logs)) == small and small


def test_stability_ranking_breaks_ties_by_name(make_logs):
    logs = make_logs(*[{"endpoint": e} for e in "cabd"])
    assert [r.endpoint for r in scores.least_stable_endpoints(logs, 3).collect()] == ["a", "b", "c"]


@pytest.mark.parametrize(
    "report, keys",
    [
        (metrics.kpis, "service_name"),
        (metrics.percentiles, ""),
        (metrics.latency_trend, "date"),
        (metrics.endpoint_performance, "endpoint, service_name"),
        (metrics.service_summary, "service_name"),
        (compare.top_bucket, "endpoint"),
    ],
)
def test_log_rows_are_counted_per_latency_before_any_shuffle(logs, report, keys):
    """The shuffle fed by the scan is keyed by latency too and gets partial counts."""
    plan = re.sub(r"#\d+L?|_\d+", "", report(logs)._jdf.queryExecution().executedPlan().toString())
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    wanted = "hashpartitioning(" + ", ".join(filter(None, [keys, "response_time_ms"]))
    assert wanted in shuffles[-1]
    after = plan.split(shuffles[-1])[1].strip().splitlines()[0]
    assert "HashAggregate" in after and "partial_count" in after


def test_a_hot_group_gives_exact_figures(spark, make_logs):
    hot = make_logs({"response_time_ms": 7}).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(200_000))))
    rows = hot.drop("copy").unionByName(make_logs(*[{"response_time_ms": 1000 + i} for i in range(100)]))
    row = metrics.percentiles(rows).first()
    assert (row.p50, row.p99, row["max"]) == (7.0, 7.0, 1099.0)
    assert compare.top_bucket(rows).first().p95_latency == 1099
    assert outliers.p99_outliers(rows).count() == 100


def test_reports_read_the_log_once(spark, logs, monkeypatch, tmp_path):
    """Scans of the log in the plans of what is kept on the way and of the result."""
    from weirlog.operators import incidents
    from weirlog.plans import contexts
    from weirlog.sources import shared

    logs.write.parquet(f"{tmp_path}/only-log")
    table, seen = spark.read.parquet(f"{tmp_path}/only-log"), []

    def scans(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")

    def kept(df):
        seen.append(scans(df))
        return shared.durable(df)

    for module in (metrics, contexts, incidents):
        monkeypatch.setattr(module, "durable", kept)
    reports = {
        contexts.chat_context: 1,
        metrics.service_detail: 1,
        contexts.service_contexts: 1,
        incidents.detect: 1,
        incidents.detect_in_later_half: 2,  # the middle of the time range has a pass of its own
        lambda t: incidents.incident_context(incidents.as_incidents(incidents.detect(t), F.lit("2024-01-01")), t): 2,
    }
    for report, passes in reports.items():
        seen.clear()
        result = report(table)
        assert sum(seen) + scans(result) == passes, report
