"""Generator of dirty request logs.

Every draw is a function of (seed, row id): md5 digits are read as uniform numbers.
A task that is run again after an executor is lost makes the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LOG_COLUMNS

# What each field is drawn from, uniformly.
SERVICES = ("auth-service", "user-service", "order-service", None)
ENDPOINTS = ("/login", "/Login", "/login/", "/profile", None, "")
STATUS_CODES = ("200", "201", "400", "401", "404", "500", "503", "999", None)
REGIONS = ("us-east", "us-west", "eu-central", "ap-south", None)
RELEASES = ("v1.0", "v1.1", "v2.0", None)
# Latency is one of two normal draws (mean, deviation), -1 or nothing.
FAST = (300.0, 100.0)
SLOW = (1200.0, 300.0)
MINUTES = 86_400
REPEATED_SHARE = 0.05


def _uniform(digits: Column, start: int, length: int) -> Column:
    """Hex digits as a number in [0, 1)."""
    number = F.conv(F.substring(digits, start, length), 16, 10).cast("double")
    return number / F.lit(float(16**length))


def _choice(values: Sequence[str | None], u: Column) -> Column:
    options = F.array(*[F.lit(v).cast("string") for v in values])
    return F.element_at(options, (F.floor(u * len(values)) + 1).cast("int"))


def synthetic_logs(ids: DataFrame, start: str, id_column: str = "id", seed: int = 42) -> DataFrame:
    """One dirty log per row of ``ids``, about 5% of them twice.

    ``start`` is the first instant; timestamps are whole minutes up to 60 days later.
    """
    keyed = ids.select(
        F.md5(F.concat_ws(":", F.lit(f"{seed}a"), F.col(id_column).cast("string"))).alias("a"),
        F.md5(F.concat_ws(":", F.lit(f"{seed}b"), F.col(id_column).cast("string"))).alias("b"),
    )
    a, b = F.col("a"), F.col("b")
    # Two uniforms make one standard normal (Box-Muller).
    normal = F.sqrt(-2 * F.ln(1 - _uniform(b, 1, 8))) * F.cos(F.lit(2 * 3.141592653589793) * _uniform(b, 9, 8))

    def latency(shape: tuple[float, float]) -> Column:
        return (normal * shape[1] + shape[0]).cast("bigint").cast("string")

    kind = F.floor(_uniform(a, 25, 4) * 4)
    minute = F.floor(_uniform(b, 17, 8) * (MINUTES + 1)).cast("int")
    when = F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(mins=minute)
    rows = keyed.select(
        when.cast("string").alias("timestamp"),
        _choice(SERVICES, _uniform(a, 1, 4)).alias("service_name"),
        _choice(ENDPOINTS, _uniform(a, 5, 4)).alias("endpoint"),
        _choice(STATUS_CODES, _uniform(a, 9, 4)).alias("status_code"),
        F.when(kind == 0, latency(FAST)).when(kind == 1, latency(SLOW)).when(kind == 2, "-1").alias("response_time_ms"),
        _choice(RELEASES, _uniform(a, 13, 4)).alias("release_version"),
        _choice(REGIONS, _uniform(a, 17, 4)).alias("server_region"),
        F.when(_uniform(b, 25, 8) < REPEATED_SHARE, 2).otherwise(1).alias("copies"),
    )
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*LOG_COLUMNS)


def generate(spark: SparkSession, rows: int = 50_000, start: str = "2024-01-01", seed: int = 42) -> DataFrame:
    return synthetic_logs(spark.range(rows), start, seed=seed)
