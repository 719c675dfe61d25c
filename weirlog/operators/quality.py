"""Profiling queries and the older two-stage cleaning over a typed raw table.

These keep their own rules: spaces only are trimmed, trailing slashes stay, rows
without a timestamp stay, and the first stage writes ``unknown_service`` with an
underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import LOG_COLUMNS, UNKNOWN, UNKNOWN_ENDPOINT, UNKNOWN_SERVICE


def typed(raw: DataFrame) -> DataFrame:
    """The raw table with typed, nullable columns."""
    return raw.select(
        F.col("timestamp").try_cast("timestamp_ntz").alias("timestamp"),
        "service_name",
        "endpoint",
        F.col("status_code").try_cast("int").alias("status_code"),
        F.col("response_time_ms").try_cast("int").alias("response_time_ms"),
        "release_version",
        "server_region",
    )


def row_count(table: DataFrame) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("row_count"))


def preview(table: DataFrame, rows: int = 5) -> DataFrame:
    """The first rows by content, so that the preview is repeatable."""
    return table.orderBy(*[F.col(c).asc_nulls_first() for c in LOG_COLUMNS]).limit(rows)


def null_profile(table: DataFrame) -> DataFrame:
    return table.agg(
        F.count_if(F.col("service_name").isNull()).alias("null_service"),
        F.count_if(F.col("endpoint").isNull() | (F.col("endpoint") == "")).alias("null_endpoint"),
        F.count_if(F.col("status_code").isNull()).alias("null_status"),
        F.count_if(F.col("response_time_ms").isNull()).alias("null_latency"),
    )


def invalid_count(table: DataFrame) -> DataFrame:
    bad = ~F.col("status_code").between(200, 599) | (F.col("response_time_ms") <= 0)
    return table.where(bad).agg(F.count(F.lit(1)).alias("invalid_rows"))


def _in_range() -> Column:
    return F.col("status_code").between(200, 599) & (F.col("response_time_ms") > 0)


def clean_stage1(table: DataFrame) -> DataFrame:
    return (
        table.where(_in_range())
        .select(
            "timestamp",
            F.coalesce("service_name", F.lit("unknown_service")).alias("service_name"),
            F.lower(F.trim("endpoint")).alias("endpoint"),
            "status_code",
            "response_time_ms",
            F.coalesce("release_version", F.lit(UNKNOWN)).alias("release_version"),
            F.coalesce("server_region", F.lit(UNKNOWN)).alias("server_region"),
        )
        .distinct()
    )


def clean_stage2(stage1: DataFrame) -> DataFrame:
    blank = F.col("endpoint").isNull() | (F.col("endpoint") == "")
    return (
        stage1.where(_in_range())
        .select(
            "timestamp",
            F.coalesce("service_name", F.lit(UNKNOWN_SERVICE)).alias("service_name"),
            F.when(blank, F.lit(UNKNOWN_ENDPOINT)).otherwise(F.lower(F.trim("endpoint"))).alias("endpoint"),
            "status_code",
            "response_time_ms",
            F.coalesce("release_version", F.lit(UNKNOWN)).alias("release_version"),
            F.coalesce("server_region", F.lit(UNKNOWN)).alias("server_region"),
        )
        .distinct()
    )


def raw_vs_clean(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Both row counts in one row."""
    return raw.agg(F.count(F.lit(1)).alias("raw_rows")).withColumn(
        "clean_rows", cleaned.agg(F.count(F.lit(1))).scalar()
    )


def unknown_count(table: DataFrame) -> DataFrame:
    unknown = (F.col("endpoint") == UNKNOWN_ENDPOINT) | (F.col("service_name") == UNKNOWN_SERVICE)
    return table.where(unknown).agg(F.count(F.lit(1)).alias("unknown_rows"))


def residual_nulls(table: DataFrame) -> DataFrame:
    missing = F.col("endpoint").isNull() | F.col("service_name").isNull()
    return table.where(missing).agg(F.count(F.lit(1)).alias("null_rows"))
