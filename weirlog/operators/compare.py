"""Release comparisons and the top latency bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import percent_change, round_table
from ..functions.status import regression_verdict
from .filters import filter_releases, name_list
from .metrics import LATENCY, latency_cells, release_performance


def _compared(ordered: DataFrame, position: Column, by: Sequence[str]) -> DataFrame:
    """Each release against the one before it. The input has one row per release."""
    window = Window.partitionBy(*by).orderBy(position)
    before = ordered.withColumn(
        "old",
        F.lag(F.struct("release_version", "avg_latency_ms", "p95_latency_ms", "error_rate_percent")).over(window),
    )
    first = F.col("old").isNull()
    avg = percent_change(F.col("old.avg_latency_ms"), F.col("avg_latency_ms"))
    p95 = percent_change(F.col("old.p95_latency_ms"), F.col("p95_latency_ms"))
    points = F.col("error_rate_percent") - F.col("old.error_rate_percent")

    def change(value: Column) -> Column:
        return F.when(first, F.lit(0.0)).otherwise(round_table(value))

    return before.select(
        *by,
        "release_version",
        F.col("old.release_version").alias("previous_release_version"),
        change(avg).alias("avg_latency_change_percent"),
        change(p95).alias("p95_latency_change_percent"),
        change(points).alias("error_rate_change_points"),
        F.when(first, F.lit(False)).otherwise((avg > 20) | (p95 > 20) | (points > 1.0)).alias("is_regression"),
    )


def regressions(performance: DataFrame, order: str | Sequence[str], *by: str) -> DataFrame:
    """Release-over-release changes in the caller's chronological order.

    Names without data are skipped, so a release is compared with the previous one
    that has data; the first of these is the baseline. The window sees at most one
    row per name in ``order`` (and ``by`` group).
    """
    names = performance.sparkSession.range(1).select(
        F.posexplode(F.lit(name_list(order))).alias("position", "release_version")
    )
    return _compared(performance.join(names, "release_version"), F.col("position"), by)


def regressions_by_name(performance: DataFrame, *by: str) -> DataFrame:
    """As ``regressions``, in lexicographic order of the release names."""
    return _compared(performance, F.col("release_version"), by)


def release_pair(performance: DataFrame, old: str | None = None, new: str | None = None) -> DataFrame:
    """One release against another; by default the last two in lexicographic order."""
    if old and new:
        if old == new:
            raise ValueError("a release is compared with another one")
        pair = regressions(performance, [old, new]).where(F.col("release_version") == new)
        return pair.where(F.col("previous_release_version").isNotNull())
    newest = performance.agg(F.max("release_version")).scalar()
    return regressions_by_name(performance).where(
        (F.col("release_version") == newest) & F.col("previous_release_version").isNotNull()
    )


def release_stability(performance: DataFrame) -> DataFrame:
    """Changes with a verdict, without the baseline release."""
    table = regressions_by_name(performance).where(F.col("previous_release_version").isNotNull())
    return table.withColumn(
        "verdict",
        regression_verdict(
            F.col("is_regression"), F.col("avg_latency_change_percent"), F.col("p95_latency_change_percent")
        ),
    )


def compare_releases(logs: DataFrame, releases: str | Sequence[str]) -> DataFrame:
    return release_performance(filter_releases(logs, releases))


def top_bucket(logs: DataFrame, buckets: int = 20) -> DataFrame:
    """Mean and maximum of the slowest of ``buckets`` equal-sized buckets per endpoint.

    The last of N equal buckets holds the ``count div N`` slowest requests (an
    endpoint with fewer than N requests has none). That is taken from the counts per
    latency value, so no endpoint's rows are ever sorted: the windows run over one
    row per distinct latency.
    """
    cells = latency_cells(logs, "endpoint").select("endpoint", LATENCY, "n")
    slowest_first = Window.partitionBy("endpoint").orderBy(F.col(LATENCY).desc())
    slower = F.sum("n").over(slowest_first.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    total = F.sum("n").over(Window.partitionBy("endpoint"))
    size = F.call_function("div", total, F.lit(buckets))
    ranked = cells.withColumn("slower", slower).withColumn("size", size)
    taken = F.least(F.col("n"), F.col("size") - F.col("slower"))
    return (
        ranked.withColumn("taken", taken)
        .where(F.col("taken") > 0)
        .groupBy("endpoint")
        .agg(
            (F.sum(F.col(LATENCY) * F.col("taken")) / F.sum("taken")).alias("avg_latency"),
            F.max(LATENCY).alias("p95_latency"),
        )
    )
