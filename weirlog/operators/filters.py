"""Row filters. Each is a chain of plain predicates, so they reach the parquet scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month_of(timestamp: Column) -> Column:
    """First day of the month, the partition that a log belongs to."""
    return F.trunc(timestamp.cast("date"), "month")


def filter_logs(
    logs: DataFrame,
    service: str | None = None,
    endpoint: str | None = None,
    release: str | None = None,
    region: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    status: int | None = None,
) -> DataFrame:
    """Keep rows that match every given filter; None, '' and status 0 mean no filter.

    Dates are inclusive instants: a bare ``date_to`` is midnight of that day. On a
    table partitioned by ``log_month`` they also select the months to read.
    """
    equal = {
        "service_name": service,
        "endpoint": endpoint,
        "release_version": release,
        "server_region": region,
        "status_code": status,
    }
    for column, value in equal.items():
        if value:
            logs = logs.where(F.col(column) == value)
    monthly = "log_month" in logs.columns
    if date_from:
        start = F.lit(date_from).cast("timestamp_ntz")
        logs = logs.where(F.col("timestamp") >= start)
        logs = logs.where(F.col("log_month") >= month_of(start)) if monthly else logs
    if date_to:
        end = F.lit(date_to).cast("timestamp_ntz")
        logs = logs.where(F.col("timestamp") <= end)
        logs = logs.where(F.col("log_month") <= month_of(end)) if monthly else logs
    return logs


def name_list(names: str | Sequence[str]) -> list[str]:
    """Comma list (or sequence) to trimmed, non-blank names; none at all is an error."""
    parts = names.split(",") if isinstance(names, str) else names
    kept = [p.strip() for p in parts if p.strip()]
    if not kept:
        raise ValueError("give at least one release")
    return kept


def filter_releases(logs: DataFrame, releases: str | Sequence[str]) -> DataFrame:
    return logs.where(F.col("release_version").isin(name_list(releases)))


def search_endpoints(endpoints: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring match on endpoint or service; ``%`` and ``_`` are literal."""
    needle = F.lower(F.lit(text))
    return endpoints.where(
        F.contains(F.lower("endpoint"), needle) | F.contains(F.lower("service_name"), needle)
    )
