"""Health classes, bands and verdicts. The limits are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import UNKNOWN_SERVICE
from .numbers import clip, round_figure


def is_error(status_code: Column) -> Column:
    return status_code >= 400


def health_class(error_percent: Column, p95_ms: Column) -> Column:
    return (
        F.when((error_percent > 5) | (p95_ms > 2000), F.lit("Critical"))
        .when((error_percent > 2) | (p95_ms > 1000), F.lit("Degraded"))
        .otherwise(F.lit("Healthy"))
    )


def service_health(service: Column, error_percent: Column, p95_ms: Column) -> Column:
    """As ``health_class``, but logs without a service identifier are not graded."""
    return F.when(service == UNKNOWN_SERVICE, F.lit("Unknown")).otherwise(
        health_class(error_percent, p95_ms)
    )


def error_rate_band(error_percent: Column) -> Column:
    return (
        F.when(error_percent > 10, F.lit("critical"))
        .when(error_percent > 3, F.lit("warning"))
        .otherwise(F.lit("healthy"))
    )


def availability_band(availability_percent: Column) -> Column:
    return (
        F.when(availability_percent > 99, F.lit("healthy"))
        .when(availability_percent > 95, F.lit("warning"))
        .otherwise(F.lit("critical"))
    )


def regression_verdict(is_regression: Column, avg_change: Column, p95_change: Column) -> Column:
    worst = F.greatest(F.abs(avg_change), F.abs(p95_change))
    return (
        F.when(~is_regression, F.lit("Stable"))
        .when(worst > 50, F.lit("Regression"))
        .otherwise(F.lit("Minor Regression"))
    )


def reliability(p95_ms: Column, error_percent: Column, baseline_p95_ms: float) -> Column:
    """Struct of the three 0-100 component scores, their blend and its class."""
    latency = clip(100 - p95_ms / F.lit(max(float(baseline_p95_ms), 1.0)) * 100.0, 0.0, 100.0)
    error = clip(100 - error_percent * 10.0, 0.0, 100.0)
    availability = clip(100 - error_percent, 0.0, 100.0)
    overall = round_figure(latency * 0.4 + error * 0.4 + availability * 0.2, 1)
    return F.struct(
        round_figure(latency, 1).alias("latency_score"),
        round_figure(error, 1).alias("error_score"),
        round_figure(availability, 1).alias("availability_score"),
        overall.alias("overall_score"),
        F.when(overall < 60, F.lit("Critical"))
        .when(overall < 85, F.lit("Degraded"))
        .otherwise(F.lit("Healthy"))
        .alias("status"),
    )
