"""Cleaning of raw request logs and the data-quality report.

The stages are separate functions so that each can be used with ``df.transform``;
``clean`` chains them into one narrow projection followed by the one shuffle that
removing duplicates needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import default_if_blank, normalize_endpoint, to_number
from ..functions.times import FORMATS, ISO, fitting_formats, parse_timestamp, split_half
from ..schema import LOG_COLUMNS, UNKNOWN, UNKNOWN_ENDPOINT, UNKNOWN_SERVICE

_LONG_LIMIT = float(2**63)


def timestamp_formats(raw: DataFrame) -> DataFrame:
    """How many raw timestamps fit each known format, and which format the column is taken to have.

    A column has one format, and the first value that fits any decides which; where that value fits several,
    the first of ``FORMATS`` does. First means first in the files, in the order of their names; rows
    that come from no file are taken in the order of their partitions. One aggregate over one column; a
    value that is ISO text is tried on no other format. All formats are listed, also if nothing fits.
    """
    place = F.struct(F.input_file_name(), F.input_file_block_start(), F.monotonically_increasing_id())
    value, half = split_half(F.col("timestamp"))
    is_iso = parse_timestamp(F.col("timestamp")).isNotNull()
    values = raw.select(value.alias("value"), half.alias("half"), is_iso.alias("is_iso"), place.alias("place"))
    formats = fitting_formats(F.col("value"), F.col("half"), F.col("is_iso"))
    values = values.select(formats.alias("formats"), "place").where(F.size("formats") > 0)
    counts = values.groupBy("formats").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place"))
    each = counts.select("n", "place", F.posexplode("formats").alias("nth", "format"))
    found = each.groupBy("format").agg(F.sum("n").alias("n_values"), F.min(F.struct("place", "nth")).alias("first"))
    listed = raw.sparkSession.createDataFrame([(f,) for f in FORMATS], "format string")
    used = F.min_by("format", "first").over(Window.partitionBy())  # one row per format
    return listed.join(found, "format", "left").select(
        "format", F.coalesce("n_values", F.lit(0)).alias("n_values"), F.col("format").eqNullSafe(used).alias("is_used")
    )


def infer_timestamp_format(raw: DataFrame) -> str:
    """The format that the timestamps of ``raw`` are taken to have; ISO if no value fits any."""
    used = timestamp_formats(raw).where("is_used").first()
    return used["format"] if used else ISO


def coerce(raw: DataFrame, timestamp_format: str = ISO, *keep: str) -> DataFrame:
    """Status and latency to DOUBLE, timestamp to TIMESTAMP_NTZ; failures become null. ``keep``: further columns."""
    return raw.select(
        parse_timestamp(F.col("timestamp"), timestamp_format).alias("timestamp"),
        "service_name",
        "endpoint",
        to_number(F.col("status_code")).alias("status_code"),
        to_number(F.col("response_time_ms")).alias("response_time_ms"),
        "release_version",
        "server_region",
        *keep,
    )


def valid_status() -> Column:
    return F.coalesce(F.col("status_code").between(200, 599), F.lit(False))


def valid_latency() -> Column:
    ms = F.col("response_time_ms")
    return F.coalesce((ms > 0) & (ms < F.lit(_LONG_LIMIT)), F.lit(False))


def valid_timestamp() -> Column:
    return F.col("timestamp").isNotNull()


def keep_valid_status(df: DataFrame) -> DataFrame:
    return df.where(valid_status())


def keep_valid_latency(df: DataFrame) -> DataFrame:
    return df.where(valid_latency())


def keep_valid_timestamp(df: DataFrame) -> DataFrame:
    return df.where(valid_timestamp())


def normalize(df: DataFrame, *keep: str) -> DataFrame:
    """Text fields to their published form; numbers truncated to integers."""
    return df.select(
        "timestamp",
        default_if_blank(F.col("service_name"), UNKNOWN_SERVICE).alias("service_name"),
        normalize_endpoint(F.col("endpoint")).alias("endpoint"),
        F.col("status_code").cast("int").alias("status_code"),
        F.col("response_time_ms").cast("bigint").alias("response_time_ms"),
        default_if_blank(F.col("release_version"), UNKNOWN).alias("release_version"),
        default_if_blank(F.col("server_region"), UNKNOWN).alias("server_region"),
        *keep,
    )


def deduplicate(df: DataFrame, *keep: str) -> DataFrame:
    """One row per distinct log line (and ``keep``).

    Copies collapse inside each task before the shuffle, so a line repeated any
    number of times sends at most one row per task to its reducer.
    """
    return df.dropDuplicates([*LOG_COLUMNS, *keep])


def usable(raw: DataFrame, timestamp_format: str = ISO, *keep: str) -> DataFrame:
    """Valid, normalised rows, copies included."""
    return (
        raw.transform(coerce, timestamp_format, *keep)
        .transform(keep_valid_status)
        .transform(keep_valid_latency)
        .transform(keep_valid_timestamp)
        .transform(normalize, *keep)
    )


def clean(raw: DataFrame, timestamp_format: str = ISO, *keep: str) -> DataFrame:
    """Usable rows, each once; with ``keep`` once for each of its values."""
    return raw.transform(usable, timestamp_format, *keep).transform(deduplicate, *keep)


def report(raw: DataFrame, timestamp_format: str = ISO) -> DataFrame:
    """One row of counters for a cleaning run, in one scan of the raw rows.

    Rows are first counted per distinct usable line (a null line stands for all
    dropped rows), which also gives the number of clean rows without a second pass.
    """
    typed = raw.transform(coerce, timestamp_format)
    status_ok, latency_ok, time_ok = valid_status(), valid_latency(), valid_timestamp()
    flagged = typed.select(
        "*",
        (~status_ok).alias("bad_status"),
        (status_ok & ~latency_ok).alias("bad_latency"),
        (status_ok & latency_ok & time_ok).alias("usable"),
    )
    line = F.struct(
        "timestamp",
        default_if_blank(F.col("service_name"), UNKNOWN_SERVICE).alias("service_name"),
        normalize_endpoint(F.col("endpoint")).alias("endpoint"),
        F.when(F.col("usable"), F.col("status_code").cast("int")).alias("status_code"),
        F.when(F.col("usable"), F.col("response_time_ms").cast("bigint")).alias("response_time_ms"),
        default_if_blank(F.col("release_version"), UNKNOWN).alias("release_version"),
        default_if_blank(F.col("server_region"), UNKNOWN).alias("server_region"),
    )
    lines = (
        flagged.select("bad_status", "bad_latency", F.when(F.col("usable"), line).alias("line"))
        .groupBy("line")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.count_if("bad_status").alias("bad_status"),
            F.count_if("bad_latency").alias("bad_latency"),
        )
    )
    found = F.col("line").isNotNull()
    copies = F.col("copies")

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")

    return lines.agg(
        total(copies).alias("raw_rows"),
        F.count("line").alias("clean_rows"),
        total(F.col("bad_status")).alias("dropped_invalid_status"),
        total(F.col("bad_latency")).alias("dropped_invalid_latency"),
        total(F.when(found, copies - 1)).alias("duplicates_removed"),
        total(F.when(F.col("line.endpoint") == UNKNOWN_ENDPOINT, copies)).alias("unknown_endpoint_count"),
        total(F.when(F.col("line.service_name") == UNKNOWN_SERVICE, copies)).alias("unknown_service_count"),
    )


def drop_counts(raw: DataFrame, timestamp_format: str = ISO, more: Sequence[Column] = (), keep: Sequence[str] = ()) -> DataFrame:
    """The counters of ``report`` that need no duplicate removal: one scan, no shuffle.

    ``usable_rows`` counts copies, so duplicates are ``usable_rows`` minus clean rows. ``more`` are further aggregates
    that the same scan makes, of the columns ``keep``.
    """
    typed = raw.transform(coerce, timestamp_format, *keep)
    status_ok, latency_ok, time_ok = valid_status(), valid_latency(), valid_timestamp()
    kept = status_ok & latency_ok & time_ok
    return typed.agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(~status_ok).alias("dropped_invalid_status"),
        F.count_if(status_ok & ~latency_ok).alias("dropped_invalid_latency"),
        F.count_if(kept).alias("usable_rows"),
        F.count_if(kept & (normalize_endpoint(F.col("endpoint")) == UNKNOWN_ENDPOINT)).alias("unknown_endpoint_count"),
        F.count_if(kept & (default_if_blank(F.col("service_name"), UNKNOWN_SERVICE) == UNKNOWN_SERVICE)).alias(
            "unknown_service_count"
        ),
        *more,
    )
