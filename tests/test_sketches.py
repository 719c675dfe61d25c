"""Mergeable sketches against exact figures."""

import random

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from weirlog.operators import metrics, sketches
from weirlog.schema import CLEAN_SCHEMA
from weirlog.streaming import jobs


@pytest.fixture(scope="module")
def busy(spark):
    """120,000 requests of two services over 30 days, latencies in a long tail, 900 endpoints."""
    at = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'") + F.make_dt_interval(days=F.pmod("id", F.lit(30)), secs=F.pmod("id", F.lit(86_399)))
    u = (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) + 1) / 1_000_004
    return spark.range(120_000).select(
        at.alias("timestamp"),
        F.when(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(3)) == 0, "a").otherwise("b").alias("service_name"),
        F.concat(F.lit("/e"), F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(900))).alias("endpoint"),
        F.when(u < 0.07, 500).when(u < 0.1, 404).otherwise(200).alias("status_code"),
        (F.lit(20) - 300 * F.log(u)).cast("bigint").alias("response_time_ms"),
        F.lit("v1").alias("release_version"),
        F.lit("x").alias("server_region"),
    )


def test_exact_parts_and_rank_errors(busy):
    figures = sketches.figures_of_sketches(sketches.request_sketches(busy, "service_name"), "service_name")
    exact = {r.service_name: r for r in metrics.kpis(busy, "service_name").collect()}
    for row in figures.collect():
        own = exact[row.service_name]
        for name in ("total_requests", "error_rate_percent", "availability_percent", "avg_latency_ms", "slow_requests"):
            assert row[name] == own[name], name
        assert abs(row.p95_latency_ms - own.p95_latency_ms) < 0.03 * own.p95_latency_ms
        assert abs(row.endpoints - 900) < 3 * 0.016 * 900
    errors = sketches.rank_errors(figures, busy, "service_name").collect()
    assert len(errors) == 6 and max(r.rank_error for r in errors) < 0.004


def test_thirty_days_merged_equal_one_sketch(busy):
    """Sums and distinct counts are the same, quantiles within the error of one sketch."""
    daily = sketches.request_sketches(busy.withColumn("day", F.to_date("timestamp")), "day", "service_name")
    assert daily.count() == 60
    merged = sketches.figures_of_sketches(sketches.merge_sketches(daily, "service_name"), "service_name")
    once = sketches.figures_of_sketches(sketches.request_sketches(busy, "service_name"), "service_name")
    quantiles = [f"{name}_latency_ms" for name in sketches.QUANTILES]
    assert rows_of(merged.drop(*quantiles)) == rows_of(once.drop(*quantiles))
    assert max(r.rank_error for r in sketches.rank_errors(merged, busy, "service_name").collect()) < 0.004


def test_sketches_are_small(busy):
    sizes = sketches.request_sketches(busy, "service_name").select(F.octet_length("latencies"), F.octet_length("endpoints"))
    assert all(latencies < 40_000 and endpoints < 5_000 for latencies, endpoints in sizes.collect())


def test_streamed_sketches_merge(spark, busy, tmp_path):
    out = str(tmp_path / "sketches")
    add = jobs.add_sketches_to(out, "service_name", merge_every=3)
    parts = [busy.where(F.pmod(F.xxhash64(F.lit(7), "endpoint"), F.lit(7)) == i) for i in range(7)]
    for number, part in enumerate(parts):
        add(part, number)
        if number in (2, 4):
            add(part, number)  # run again
    current = sketches.merge_sketches(jobs.current_sketches(spark, out, "service_name"), "service_name")
    figures = sketches.figures_of_sketches(current, "service_name")
    once = sketches.figures_of_sketches(sketches.request_sketches(busy, "service_name"), "service_name")
    quantiles = [f"{name}_latency_ms" for name in sketches.QUANTILES]
    assert rows_of(figures.drop(*quantiles)) == rows_of(once.drop(*quantiles))
    assert max(r.rank_error for r in sketches.rank_errors(figures, busy, "service_name").collect()) < 0.004


def test_nothing_and_one_request(spark, make_logs, tmp_path):
    empty = make_logs({}).limit(0)
    assert sketches.figures_of_sketches(sketches.request_sketches(empty, "service_name"), "service_name").count() == 0
    one = sketches.figures_of_sketches(sketches.request_sketches(make_logs({"response_time_ms": 7}), "service_name"), "service_name").first()
    assert (one.p50_latency_ms, one.p99_latency_ms, one.max_latency_ms, one.endpoints) == (7, 7, 7, 1)
    with pytest.raises(LookupError):
        jobs.current_sketches(spark, str(tmp_path / "none"), "service_name")


def test_days_are_given_out_behind_the_watermark(spark, make_logs, tmp_path):
    """Rows in time equal the batch report; rows of days given out are counted as late, whatever the session's zone."""
    source, out, progress, cells = (str(tmp_path / n) for n in ("in", "out", "progress", "cells"))
    draw = random.Random(2)

    def day(n, count=20):
        return [{"timestamp": f"2024-03-{n:02d} {draw.randrange(24):02d}:{draw.randrange(60):02d}:00", "response_time_ms": draw.randrange(1, 900)} for _ in range(count)]

    from datetime import datetime

    def logs_of(rows):
        return make_logs(*({**r, "timestamp": datetime.fromisoformat(r["timestamp"])} for r in rows))

    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        batches = [day(9) + day(8), day(10) + day(9, 5), day(11), day(12) + day(8, 3), day(14)]
        for batch in batches:
            logs_of(batch).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(CLEAN_SCHEMA).parquet(source)
            jobs.run_available(jobs.append_to(jobs.daily_trend_stream(stream), out, progress))
            counted = jobs.add_cells_to(cells, jobs.cells_of_days)
            jobs.run_available(jobs.for_each_batch(stream, counted, f"{progress}-2"))
        trend = spark.read.parquet(out)
        in_time = [r for batch in batches for r in batch if not (batch is batches[3] and "03-08" in r["timestamp"])]
        expected = metrics.latency_trend(logs_of(in_time)).where("date <= DATE'2024-03-12'")
        assert rows_of(trend.drop("requests").select(*expected.columns)) == rows_of(expected)
        late = jobs.late_requests(trend, jobs.current_cells(spark, cells)).collect()
        assert [(str(r.date), r.late) for r in late] == [("2024-03-08", 3)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
