"""Latency outliers.

Thresholds are one-row aggregates used as scalar subqueries, so the rows are filtered
in place: the comparison is pushed to the scan and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import round_table
from ..schema import LOG_COLUMNS
from .filters import filter_logs
from .joins import size_checked
from .metrics import LATENCY, latency_cells

METHODS = ("iqr", "p99", "zscore")


def _quantiles(logs: DataFrame, *points: float) -> Column:
    """Exact latency quantiles as one array, computed once however often it is used."""
    return latency_cells(logs).agg(F.percentile(LATENCY, list(points), F.col("n")).alias("q")).scalar()


def iqr_outliers(logs: DataFrame) -> DataFrame:
    """Rows outside 1.5 interquartile ranges, with the upper fence."""
    quartiles = _quantiles(logs, 0.25, 0.75)
    q1, q3 = quartiles[0], quartiles[1]
    reach = (q3 - q1) * 1.5
    ms = F.col(LATENCY)
    return logs.where((ms < q1 - reach) | (ms > q3 + reach)).withColumn("threshold_ms", q3 + reach)


def p99_outliers(logs: DataFrame) -> DataFrame:
    p99 = _quantiles(logs, 0.99)[0]
    return logs.where(F.col(LATENCY) > p99).withColumn("threshold_ms", round_table(p99))


def _zscore(logs: DataFrame, deviation: Callable[[Column], Column]) -> Column:
    """Distance from the mean in deviations; null where the deviation is zero."""
    ms = F.col(LATENCY).cast("double")
    moments = logs.agg(F.struct(F.avg(ms).alias("mean"), deviation(ms).alias("std")).alias("moments")).scalar()
    return F.try_divide(ms - moments["mean"], moments["std"])


def zscore_outliers(logs: DataFrame) -> DataFrame:
    """Rows more than three sample standard deviations from the mean; no threshold."""
    far = F.abs(_zscore(logs, F.stddev_samp)) > 3
    return logs.where(far).withColumn("threshold_ms", F.lit(None).cast("double"))


def population_zscore_outliers(logs: DataFrame) -> DataFrame:
    """As ``zscore_outliers`` with the population deviation; the z-score is kept."""
    score = _zscore(logs, F.stddev_pop)
    return logs.where(F.abs(score) > 3).withColumn("z_score", score)


def endpoint_p95_outliers(logs: DataFrame) -> DataFrame:
    """Rows slower than their own endpoint's p95.

    The lowest p95 of all endpoints is a lower bound for every row kept; it is applied
    first, so that few rows are left if the join has to shuffle.
    """
    limits = size_checked(
        latency_cells(logs, "endpoint")
        .groupBy("endpoint")
        .agg(F.percentile(LATENCY, 0.95, F.col("n")).alias("endpoint_p95"))
    )
    lowest = limits.agg(F.min("endpoint_p95")).scalar()
    candidates = logs.where(F.col(LATENCY) > lowest)
    return (
        candidates.join(limits, "endpoint")
        .where(F.col(LATENCY) > F.col("endpoint_p95"))
        .select(*LOG_COLUMNS, round_table(F.col("endpoint_p95")).alias("endpoint_p95"))
    )


def outliers(logs: DataFrame, method: str = "p99") -> DataFrame:
    """All outlier rows by one of ``METHODS``, with the threshold (null for z-scores)."""
    if method not in METHODS:
        raise ValueError(f"unknown outlier method {method!r}, use one of {METHODS}")
    return {"iqr": iqr_outliers, "p99": p99_outliers, "zscore": zscore_outliers}[method](logs)


def outlier_page(
    logs: DataFrame,
    method: str = "p99",
    service: str | None = None,
    endpoint: str | None = None,
    limit: int = 100,
) -> DataFrame:
    """The slowest ``limit`` (at most 1000) outliers with the count of all of them."""
    if limit > 1000:
        raise ValueError("limit is at most 1000")
    found = outliers(filter_logs(logs, service=service, endpoint=endpoint), method)
    count = found.agg(F.count(F.lit(1)).alias("outlier_count")).scalar()
    order = [F.col(LATENCY).desc(), *[F.col(c) for c in LOG_COLUMNS if c != LATENCY]]
    return found.orderBy(*order).limit(limit).withColumns({"method": F.lit(method), "outlier_count": count})
