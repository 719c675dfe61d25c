"""Column names, table schemas, defaults and thresholds shared by every module."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# The seven columns of a request log, in storage order.
LOG_COLUMNS = (
    "timestamp",
    "service_name",
    "endpoint",
    "status_code",
    "response_time_ms",
    "release_version",
    "server_region",
)

# Placeholders written where the source log had nothing.
UNKNOWN_SERVICE = "unknown-service"
UNKNOWN_ENDPOINT = "unknown-endpoint"
UNKNOWN = "unknown"

# Incident life cycle.
INCIDENT_STATUSES = ("open", "acknowledged", "resolved")

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in LOG_COLUMNS])

CLEAN_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("service_name", T.StringType()),
        T.StructField("endpoint", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("response_time_ms", T.LongType()),
        T.StructField("release_version", T.StringType()),
        T.StructField("server_region", T.StringType()),
    ]
)

INCIDENT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("started_at", T.TimestampNTZType()),
        T.StructField("ended_at", T.TimestampNTZType()),
        T.StructField("trigger_type", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("updated_at", T.TimestampNTZType()),
    ]
)


@dataclass(frozen=True)
class Thresholds:
    """Default limits of the incident rules and the KPI cards."""

    slow_request_ms: int = 1000
    high_error_rate_percent: float = 5.0
    high_latency_p95_ms: float = 1500
    latency_regression_multiplier: float = 1.5
    reliability_baseline_p95_ms: float = 1500.0


DEFAULTS = Thresholds()
