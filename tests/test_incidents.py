import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from weirlog.operators import incidents as inc


def service(name, errors, total, ms=100, endpoint="/x"):
    return [
        {"service_name": name, "status_code": 500 if i < errors else 200, "response_time_ms": ms, "endpoint": endpoint}
        for i in range(total)
    ]


def test_limits_are_strict_and_severity_doubles(make_logs):
    logs = make_logs(*service("at", 1, 20), *service("over", 2, 20), *service("far", 3, 20), *service("slow", 0, 5, 1600))
    found = {(r.service, r.trigger_type): r.severity for r in inc.detect(logs).collect()}
    assert found == {
        ("over", "high_error_rate"): "medium", ("far", "high_error_rate"): "high", ("slow", "high_latency"): "medium",
    }


def test_texts(make_logs):
    logs = make_logs(*service("s", 1, 2, 2251), *service("s", 0, 2, 2251, "/y"))
    found = {r.trigger_type: r for r in inc.detect(logs).collect()}
    error, latency = found["high_error_rate"], found["high_latency"]
    assert error.title == "High Error Rate — s"
    assert error.description == "Error rate 25.0% exceeds threshold 5.0%. Affected endpoints: /x, /y."
    assert (latency.title, latency.severity) == ("High API Latency — s", "high")
    assert latency.description == "P95 latency 2251ms exceeds threshold 1500ms. Affected endpoints: /x, /y."


def test_sudden_increase_needs_a_baseline(make_logs):
    now = make_logs(*service("s", 0, 3, 301), *service("new", 0, 1, 900))
    before = make_logs(*service("s", 0, 2, 200), *service("gone", 0, 1, 1))
    assert inc.detect(now).count() == 0
    row = inc.detect(now, before).collect()
    assert [(r.service, r.trigger_type, r.severity) for r in row] == [("s", "sudden_latency_increase", "high")]
    assert row[0].description == "Average latency jumped from 200ms to 301ms (>1.5x baseline)."
    assert inc.detect(make_logs(*service("s", 0, 3, 300)), before).count() == 0


def test_zero_thresholds_mean_defaults():
    limits = inc.thresholds(0, None, 0.0)
    assert (limits.high_error_rate_percent, limits.high_latency_p95_ms, limits.latency_regression_multiplier) == (
        5.0, 1500, 1.5,
    )
    assert inc.thresholds(1.0).high_error_rate_percent == 1.0


def test_empty_log_has_no_incidents(logs):
    empty = logs.where("false")
    assert inc.detect(empty).count() == 0
    assert inc.detect(empty, empty).count() == 0


def test_five_worst_endpoints_with_ties_by_name(make_logs):
    rows = []
    for name, errors in (("/f", 1), ("/e", 0), ("/d", 0), ("/c", 2), ("/b", 0), ("/a", 0), ("/z", 0)):
        rows += service("s", errors, 4, endpoint=name)
    assert inc.affected_endpoints(make_logs(*rows)).first().affected_endpoints == ["/c", "/f", "/a", "/b", "/d"]


@pytest.fixture()
def table(spark, make_logs):
    found = inc.detect(make_logs(*service("a", 5, 5), *service("b", 5, 5), *service("c", 5, 5)))
    return inc.as_incidents(found, F.lit("2024-01-01 10:00:00"))


def change(spark, table, name, status, at):
    incident = table.where(F.col("service") == name).first().id
    return spark.createDataFrame([(incident, status, at)], "id string, status string, changed_at string")


def test_only_open_incidents_block(spark, table):
    for status, new in (("acknowledged", 1), ("resolved", 1), ("open", 0)):
        known = inc.update_status(table, change(spark, table, "a", status, "2024-01-02 00:00:00"))
        violations = table.select("title", "severity", "service", "trigger_type", "description")
        assert inc.newly_violated(violations, known).count() == new
        assert inc.already_open(violations, known).count() == 3 - new
        counts = inc.detection_counts(violations, known).first()
        assert (counts.incidents_created, counts.incidents_already_open) == (new, 3 - new)


def test_life_cycle(spark, table):
    def ended(t):
        row = t.where("service = 'b'").first()
        return row.status, str(row.ended_at) if row.ended_at else None

    resolved = inc.update_status(table, change(spark, table, "b", "resolved", "2024-01-02 00:00:00"))
    assert ended(resolved) == ("resolved", "2024-01-02 00:00:00")
    again = inc.update_status(resolved, change(spark, table, "b", "resolved", "2024-01-03 00:00:00"))
    assert ended(again) == ("resolved", "2024-01-02 00:00:00")
    reopened = inc.update_status(again, change(spark, table, "b", "open", "2024-01-04 00:00:00"))
    assert ended(reopened) == ("open", None)
    assert rows_of(reopened.where("service <> 'b'")) == rows_of(table.where("service <> 'b'"))
    with pytest.raises(Exception, match="invalid incident status"):
        inc.update_status(table, change(spark, table, "b", "closed", "2024-01-04 00:00:00")).collect()


def test_several_changes_of_one_incident_are_folded(spark, table):
    def after(*steps):
        changes = [change(spark, table, "b", status, at) for status, at in steps]
        all_changes = changes[0]
        for more in changes[1:]:
            all_changes = all_changes.unionByName(more)
        updated = inc.update_status(table, all_changes)
        assert updated.count() == table.count()
        row = updated.where("service = 'b'").first()
        return row.status, str(row.ended_at) if row.ended_at else None

    second, third, fourth = (f"2024-01-0{d} 00:00:00" for d in (2, 3, 4))
    assert after(("resolved", third), ("acknowledged", second)) == ("resolved", third)
    assert after(("resolved", second), ("open", third)) == ("open", None)
    assert after(("resolved", second), ("resolved", third)) == ("resolved", second)
    assert after(("resolved", second), ("open", third), ("resolved", fourth)) == ("resolved", fourth)


def test_halves_of_one_log_equal_two_logs(logs):
    from weirlog.operators import metrics

    assert rows_of(inc.detect_in_later_half(logs)) == rows_of(inc.detect(metrics.later_half(logs), metrics.earlier_half(logs)))


def test_context_of_a_service_without_logs(table, make_logs):
    rows = {r.service: r for r in inc.incident_context(table, make_logs(*service("a", 1, 4))).collect()}
    assert (rows["a"].error_rate_percent, rows["a"].affected_endpoints) == (25.0, ["/x"])
    assert (rows["b"].error_rate_percent, rows["b"].p95_latency_ms, rows["b"].affected_endpoints) == (0.0, 0.0, [])
