"""KPIs and latency tables.

Every report with a percentile is computed in two steps. ``latency_cells`` counts
requests per (group, latency value); the counting is a hash aggregate with map-side
combine and its shuffle key contains the latency, so a group that holds a third of
all rows is spread over the reducers. ``summarize`` then works on these counts. An
exact percentile of a group thus sees its distinct millisecond values, never its rows.

The same counts can be kept beside stored logs (``log_counts``). Every report takes such a
table in the place of logs and then adds counts up instead of counting rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import percent_change, percent_of, round_figure, round_table
from ..functions.status import health_class, is_error, service_health
from ..schema import DEFAULTS
from ..sources.shared import durable

LATENCY = "response_time_ms"

KPI_COLUMNS = (
    "total_requests",
    "error_rate_percent",
    "avg_latency_ms",
    "p95_latency_ms",
    "p99_latency_ms",
    "availability_percent",
    "slow_requests",
    "active_services",
    "failed_requests",
    "error_rate_4xx_percent",
    "error_rate_5xx_percent",
)
CHANGE_COLUMNS = ("error_rate_change_points", "avg_latency_change_percent")


#: What stored counts are kept by, besides the latency value.
COUNT_KEYS = ("day", "service_name", "endpoint", "release_version", "server_region")


def log_counts(logs: DataFrame, *more: str) -> DataFrame:
    """Requests, 4xx and 5xx by day, dimensions and latency value, with the first and last instant counted.

    What reports need of logs unless a filter asks for single rows (a status, a part of a day).
    """
    keys = [F.to_date("timestamp").alias("day"), *COUNT_KEYS[1:], LATENCY, *more]
    return logs.groupBy(*keys).agg(*_counts(logs), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"))


def is_counted(frame: DataFrame) -> bool:
    """Whether a frame holds request counts instead of logs."""
    return "n_4xx" in frame.columns


def _counts(frame: DataFrame) -> list[Column]:
    if is_counted(frame):
        return [F.sum(c).alias(c) for c in ("n", "n_4xx", "n_5xx")]
    code = F.col("status_code")
    return [
        F.count(F.lit(1)).alias("n"),
        F.count_if(is_error(code) & (code < 500)).alias("n_4xx"),
        F.count_if(code >= 500).alias("n_5xx"),
    ]


def latency_cells(logs: DataFrame, *keys: str | Column) -> DataFrame:
    """Requests, 4xx and 5xx per (keys, latency value)."""
    return logs.groupBy(*keys, LATENCY).agg(*_counts(logs))


def dimension_cells(logs: DataFrame, dimensions: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``latency_cells`` of several dimensions in one scan, as (by, dimension, value)."""
    columns = [*by, *dimensions, LATENCY]
    sets = [[*by, d, LATENCY] for d in dimensions]
    which = F.coalesce(*[F.when(F.grouping(d) == 0, F.lit(d)) for d in dimensions])
    return (
        logs.groupingSets(sets, *columns)
        .agg(*_counts(logs), which.alias("dimension"))
        .withColumn("value", F.coalesce(*[F.col(d).cast("string") for d in dimensions]))
        .drop(*dimensions)
    )


def _figures(slow_threshold_ms: int) -> list[Column]:
    """Aggregates over cells that every table is made from."""
    n, ms = F.col("n"), F.col(LATENCY)
    return [
        F.coalesce(F.sum(n), F.lit(0)).alias("requests"),
        (F.sum(ms * n) / F.sum(n)).alias("avg_ms"),
        F.percentile(ms, [0.5, 0.95, 0.99], n).alias("pct_ms"),
        F.max(ms).alias("max_ms"),
        F.coalesce(F.sum("n_4xx"), F.lit(0)).alias("errors_4xx"),
        F.coalesce(F.sum("n_5xx"), F.lit(0)).alias("errors_5xx"),
        F.coalesce(F.sum(F.when(ms > slow_threshold_ms, n)), F.lit(0)).alias("slow"),
    ]


def summarize(
    cells: DataFrame, *keys: str, slow_threshold_ms: int = DEFAULTS.slow_request_ms, extra: Sequence[Column] = ()
) -> DataFrame:
    """Unrounded figures per group; zeros for an empty log when there are no keys."""
    grouped = cells.groupBy(*keys).agg(*_figures(slow_threshold_ms), *extra)
    zero = F.lit(0.0)
    return grouped.select(
        "*",
        F.coalesce(F.col("pct_ms")[0], zero).alias("p50_ms"),
        F.coalesce(F.col("pct_ms")[1], zero).alias("p95_ms"),
        F.coalesce(F.col("pct_ms")[2], zero).alias("p99_ms"),
        (F.col("errors_4xx") + F.col("errors_5xx")).alias("errors"),
        percent_of(F.col("errors_4xx") + F.col("errors_5xx"), F.col("requests")).alias("error_rate"),
        percent_of(F.col("errors_4xx"), F.col("requests")).alias("error_rate_4xx"),
        percent_of(F.col("errors_5xx"), F.col("requests")).alias("error_rate_5xx"),
    ).withColumns(
        {
            "avg_ms": F.coalesce("avg_ms", zero),
            "max_ms": F.coalesce(F.col("max_ms").cast("double"), zero),
        }
    )


def error_rate(logs: DataFrame) -> DataFrame:
    if is_counted(logs):
        n = F.coalesce(F.sum("n"), F.lit(0))
        return logs.agg(percent_of(F.sum(F.col("n_4xx") + F.col("n_5xx")), n).alias("error_rate_percent"))
    failed = F.count_if(is_error(F.col("status_code")))
    return logs.agg(percent_of(failed, F.count(F.lit(1))).alias("error_rate_percent"))


def percentiles(logs: DataFrame) -> DataFrame:
    """avg, p50, p95, p99 and max of latency; zeros for an empty log."""
    return summarize(latency_cells(logs)).select(
        F.col("avg_ms").alias("avg"),
        round_table(F.col("p50_ms")).alias("p50"),
        round_table(F.col("p95_ms")).alias("p95"),
        round_table(F.col("p99_ms")).alias("p99"),
        F.col("max_ms").alias("max"),
    )


def latency_metrics(logs: DataFrame) -> DataFrame:
    return percentiles(logs).select(
        F.col("avg").alias("avg_latency_ms"),
        F.col("p95").alias("p95_latency_ms"),
        F.col("p99").alias("p99_latency_ms"),
        F.col("max").alias("max_latency_ms"),
    )


def _kpi_columns(active: Column) -> list[Column]:
    return [
        F.col("requests").alias("total_requests"),
        round_figure(F.col("error_rate")).alias("error_rate_percent"),
        round_figure(F.col("avg_ms")).alias("avg_latency_ms"),
        round_figure(F.col("p95_ms")).alias("p95_latency_ms"),
        round_figure(F.col("p99_ms")).alias("p99_latency_ms"),
        round_figure(100 - F.col("error_rate")).alias("availability_percent"),
        F.col("slow").alias("slow_requests"),
        active.alias("active_services"),
        F.col("errors").alias("failed_requests"),
        round_figure(F.col("error_rate_4xx")).alias("error_rate_4xx_percent"),
        round_figure(F.col("error_rate_5xx")).alias("error_rate_5xx_percent"),
    ]


def kpis_of_cells(
    cells: DataFrame, *keys: str, slow_threshold_ms: int = DEFAULTS.slow_request_ms, extra: Sequence[Column] = ()
) -> DataFrame:
    """KPI bundle per group of cells that still carry ``service_name``."""
    if "service_name" in keys:
        table = summarize(cells, *keys, slow_threshold_ms=slow_threshold_ms, extra=extra)
        active = F.lit(1).cast("bigint")
    else:
        distinct = F.count_distinct("service_name").alias("active")
        table = summarize(cells, *keys, slow_threshold_ms=slow_threshold_ms, extra=[*extra, distinct])
        active = F.col("active")
    kept = [F.col(c) for c in table.columns if c.startswith("half_")]
    return table.select(*keys, *_kpi_columns(active), *kept)


def kpis(logs: DataFrame, *keys: str, slow_threshold_ms: int = DEFAULTS.slow_request_ms) -> DataFrame:
    """KPI bundle of the whole log, or per group when keys are given."""
    cell_keys = list(dict.fromkeys([*keys, "service_name"]))
    return kpis_of_cells(latency_cells(logs, *cell_keys), *keys, slow_threshold_ms=slow_threshold_ms)


def middle_of_range(logs: DataFrame) -> Column:
    """Instant halfway between the first and the last request, as a scalar subquery."""
    first, last = F.min("timestamp"), F.max("timestamp")
    return logs.agg((first + (last - first) / 2).alias("middle")).scalar()


def with_half(logs: DataFrame) -> DataFrame:
    """Adds is_current; a table of counts that were split by halves has it already."""
    if "is_current" in logs.columns:
        return logs
    return logs.withColumn("is_current", F.col("timestamp") >= middle_of_range(logs))


def earlier_half(logs: DataFrame) -> DataFrame:
    return logs.where(F.col("timestamp") < middle_of_range(logs))


def later_half(logs: DataFrame) -> DataFrame:
    return logs.where(F.col("timestamp") >= middle_of_range(logs))


def _half_sums() -> list[Column]:
    n, ms, current = F.col("n"), F.col(LATENCY), F.col("is_current")
    errors = F.col("n_4xx") + F.col("n_5xx")
    sums = []
    for name, side in (("prev", ~current), ("curr", current)):
        sums += [
            F.coalesce(F.sum(F.when(side, n)), F.lit(0)).alias(f"half_{name}_n"),
            F.sum(F.when(side, errors)).alias(f"half_{name}_errors"),
            F.sum(F.when(side, ms * n)).alias(f"half_{name}_ms"),
        ]
    return sums


def _change_columns() -> list[Column]:
    def half(name: str) -> tuple[Column, Column, Column]:
        return F.col(f"half_{name}_n"), F.col(f"half_{name}_errors"), F.col(f"half_{name}_ms")

    (old_n, old_err, old_ms), (new_n, new_err, new_ms) = half("prev"), half("curr")
    both = (old_n > 0) & (new_n > 0)
    points = percent_of(new_err, new_n) - percent_of(old_err, old_n)
    change = percent_change(old_ms / old_n, new_ms / new_n)
    return [
        F.when(both, round_figure(points)).otherwise(F.lit(0.0)).alias("error_rate_change_points"),
        F.when(both, round_figure(change)).otherwise(F.lit(0.0)).alias("avg_latency_change_percent"),
    ]


def period_comparison(logs: DataFrame) -> DataFrame:
    """Later against earlier half of the time range; zeros when either half is empty."""
    cells = latency_cells(with_half(logs), "is_current")
    return cells.agg(*_half_sums()).select(*_change_columns())


def overview(logs: DataFrame, slow_threshold_ms: int = DEFAULTS.slow_request_ms) -> DataFrame:
    """KPI bundle and period comparison in one row, from one set of cells."""
    cells = latency_cells(with_half(logs), "service_name", "is_current")
    table = kpis_of_cells(cells, slow_threshold_ms=slow_threshold_ms, extra=_half_sums())
    return table.select(*KPI_COLUMNS, *_change_columns())


def daily(logs: DataFrame) -> DataFrame:
    return logs.withColumn("date", F.col("day") if is_counted(logs) else F.to_date("timestamp"))


def latency_trend(logs: DataFrame, *keys: str) -> DataFrame:
    """avg, p95, p99 and max per calendar day (and key); days without requests are absent."""
    return latency_trend_of_cells(latency_cells(daily(logs), *keys, "date"), *keys)


def latency_trend_of_cells(cells: DataFrame, *keys: str) -> DataFrame:
    return summarize(cells, *keys, "date").select(
        *keys,
        "date",
        round_table(F.col("avg_ms")).alias("avg_latency_ms"),
        round_table(F.col("p95_ms")).alias("p95_latency_ms"),
        round_table(F.col("p99_ms")).alias("p99_latency_ms"),
        round_table(F.col("max_ms")).alias("max_latency_ms"),
    )


def _table_columns(*names: str) -> list[Column]:
    columns = {
        "avg_latency_ms": F.col("avg_ms"),
        "p95_latency_ms": F.col("p95_ms"),
        "p99_latency_ms": F.col("p99_ms"),
        "error_rate_percent": F.col("error_rate"),
        "availability_percent": 100 - F.col("error_rate"),
    }
    return [round_table(columns[n]).alias(n) for n in names]


def endpoint_performance(logs: DataFrame) -> DataFrame:
    return endpoint_performance_of_cells(latency_cells(logs, "endpoint", "service_name"))


def endpoint_performance_of_cells(cells: DataFrame) -> DataFrame:
    keys = ("endpoint", "service_name")
    return summarize(cells, *keys).select(
        *keys,
        "requests",
        *_table_columns("avg_latency_ms", "p95_latency_ms", "p99_latency_ms", "error_rate_percent"),
        health_class(F.col("error_rate"), F.col("p95_ms")).alias("status"),
    )


def release_performance(logs: DataFrame, *by: str) -> DataFrame:
    return release_performance_of_cells(latency_cells(logs, *by, "release_version"), *by)


def release_performance_of_cells(cells: DataFrame, *by: str) -> DataFrame:
    keys = (*by, "release_version")
    return summarize(cells, *keys).select(
        *keys,
        "requests",
        *_table_columns("avg_latency_ms", "p95_latency_ms", "p99_latency_ms", "error_rate_percent"),
    )


def region_performance(logs: DataFrame, *by: str) -> DataFrame:
    return region_performance_of_cells(latency_cells(logs, *by, "server_region"), *by)


def region_performance_of_cells(cells: DataFrame, *by: str) -> DataFrame:
    keys = (*by, "server_region")
    return summarize(cells, *keys).select(
        *keys,
        "requests",
        *_table_columns("avg_latency_ms", "p95_latency_ms", "error_rate_percent", "availability_percent"),
    )


def service_summary(logs: DataFrame, *more: Column) -> DataFrame:
    """One graded row per service; the grade uses the rounded error rate."""
    return service_summary_of_cells(latency_cells(logs, "service_name"), *more)


def service_summary_of_cells(cells: DataFrame, *more: Column) -> DataFrame:
    table = summarize(cells, "service_name")
    rounded_error = round_figure(F.col("error_rate"))
    return table.select(
        "service_name",
        service_health(F.col("service_name"), rounded_error, F.col("p95_ms")).alias("status"),
        F.col("requests").alias("total_requests"),
        round_figure(F.col("avg_ms")).alias("avg_latency_ms"),
        round_figure(F.col("p95_ms")).alias("p95_latency_ms"),
        rounded_error.alias("error_rate_percent"),
        round_figure(100 - F.col("error_rate")).alias("availability_percent"),
        *more,
    )


def counts_of_sets(logs: DataFrame, sets: dict[str, Sequence[str]]) -> DataFrame:
    """Request counts of several groupings in one scan, kept: column ``counted`` names the grouping of a row."""
    columns = list(dict.fromkeys(c for keys in sets.values() for c in keys))
    found = logs.groupingSets([list(keys) for keys in sets.values()], *columns)
    absent = {name: [c for c in columns if c not in keys] for name, keys in sets.items()}
    which = F.coalesce(
        *[
            F.when(F.grouping_id(*columns) == sum(1 << (len(columns) - 1 - columns.index(c)) for c in absent[name]), F.lit(name))
            for name in sets
        ]
    )
    return durable(found.agg(*_counts(logs), which.alias("counted")))


def service_endpoints(logs: DataFrame) -> DataFrame:
    """Endpoints of each service as rows, for services with more of them than a list should hold."""
    return logs.select("service_name", "endpoint").distinct()


def service_detail(logs: DataFrame) -> DataFrame:
    """Summary, p99, sorted name lists and daily trend of every service, from one scan.

    Figures and trends come from counts per (service, day, latency value), the lists from the distinct
    (service, endpoint, release, region), which hardly grow with the log.
    """
    names = ("service_name", "endpoint", "release_version", "server_region")
    counts = counts_of_sets(daily(logs), {"date": ("service_name", "date", LATENCY), "names": names})
    cells = counts.where("counted = 'date'")
    summary = service_summary_of_cells(cells, round_figure(F.col("p99_ms")).alias("p99_latency_ms"))

    def listed(name: str, alias: str) -> Column:
        return F.sort_array(F.collect_set(name)).alias(alias)

    lists = counts.where("counted = 'names'").groupBy("service_name").agg(
        listed("endpoint", "endpoints"), listed("release_version", "releases"), listed("server_region", "regions")
    )
    point = F.struct("date", "avg_latency_ms", "p95_latency_ms", "p99_latency_ms", "max_latency_ms")
    trends = (
        latency_trend_of_cells(cells, "service_name")
        .groupBy("service_name")
        .agg(F.sort_array(F.collect_list(point)).alias("latency_trend"))
    )
    return (
        summary.join(lists, "service_name")
        .join(trends, "service_name")
        .withColumn("error_trend", F.lit(None).cast("string"))
    )


def breakdown(logs: DataFrame, by: str, dimensions: Sequence[str]) -> DataFrame:
    """Performance of every ``by`` group along several dimensions, in one scan.

    Figures that a dimension's table does not have are null: p99 for regions,
    availability for all but regions, the grade for all but endpoints.
    """
    cells = dimension_cells(logs, dimensions, by=[by])
    kind = F.col("dimension")
    table = summarize(cells, by, "dimension", "value")
    return table.select(
        by,
        "dimension",
        "value",
        "requests",
        *_table_columns("avg_latency_ms", "p95_latency_ms"),
        F.when(kind != "server_region", round_table(F.col("p99_ms"))).alias("p99_latency_ms"),
        round_table(F.col("error_rate")).alias("error_rate_percent"),
        F.when(kind == "server_region", round_table(100 - F.col("error_rate"))).alias("availability_percent"),
        F.when(kind == "endpoint", health_class(F.col("error_rate"), F.col("p95_ms"))).alias("status"),
    )


def service_breakdown(logs: DataFrame) -> DataFrame:
    return breakdown(logs, "service_name", ("endpoint", "release_version", "server_region"))


def endpoint_breakdown(logs: DataFrame) -> DataFrame:
    """Release and region tables of every endpoint, across services."""
    return breakdown(logs, "endpoint", ("release_version", "server_region")).drop("status")


def endpoint_trend(logs: DataFrame) -> DataFrame:
    return latency_trend(logs, "endpoint")


def endpoint_detail(logs: DataFrame, by_service: bool = False) -> DataFrame:
    """Endpoint summary with max, 4xx and 5xx.

    Without ``by_service`` the summary figures are those of the alphabetically first
    service of the endpoint, while max, 4xx and 5xx cover all its services. With it,
    there is one row per (endpoint, service).
    """
    keys = ("endpoint", "service_name")
    table = summarize(latency_cells(logs, *keys), *keys)
    summary = [
        "requests",
        *_table_columns("avg_latency_ms", "p95_latency_ms", "p99_latency_ms", "error_rate_percent"),
        health_class(F.col("error_rate"), F.col("p95_ms")).alias("status"),
    ]
    if by_service:
        return table.select(
            *keys,
            *summary,
            round_figure(F.col("max_ms")).alias("max_latency_ms"),
            round_figure(F.col("error_rate_4xx")).alias("error_rate_4xx_percent"),
            round_figure(F.col("error_rate_5xx")).alias("error_rate_5xx_percent"),
        )
    first = F.min_by(F.struct("service_name", *summary), "service_name")
    total = F.sum("requests")
    return (
        table.groupBy("endpoint")
        .agg(
            first.alias("first"),
            round_figure(F.max("max_ms")).alias("max_latency_ms"),
            round_figure(percent_of(F.sum("errors_4xx"), total)).alias("error_rate_4xx_percent"),
            round_figure(percent_of(F.sum("errors_5xx"), total)).alias("error_rate_5xx_percent"),
        )
        .select(
            "endpoint", "first.*", "max_latency_ms", "error_rate_4xx_percent", "error_rate_5xx_percent"
        )
    )


def regions_list(logs: DataFrame) -> DataFrame:
    return logs.select("server_region").distinct().orderBy("server_region")


def plain_error_rate_by_endpoint(logs: DataFrame) -> DataFrame:
    """Unrounded error percentage per endpoint."""
    if is_counted(logs):
        failed = F.sum(F.col("n_4xx") + F.col("n_5xx"))
        return logs.groupBy("endpoint").agg((failed * 100.0 / F.sum("n")).alias("error_rate"))
    failed = F.count_if(is_error(F.col("status_code")))
    return logs.groupBy("endpoint").agg((failed * 100.0 / F.count(F.lit(1))).alias("error_rate"))


def plain_daily_latency(logs: DataFrame) -> DataFrame:
    """Unrounded mean and maximum per day, in date order."""
    ms = F.col(LATENCY)
    n = F.col("n") if is_counted(logs) else F.lit(1)
    return (
        daily(logs)
        .groupBy(F.col("date").alias("log_date"))
        .agg((F.sum(ms * n) / F.sum(n)).alias("avg_latency"), F.max(ms).alias("max_latency"))
        .orderBy("log_date")
    )


def plain_release_performance(logs: DataFrame) -> DataFrame:
    """Unrounded mean, p95 and error rate per release.

    The p95 of integers is a multiple of 0.05; it is rounded to two places only to
    remove the noise of interpolating in binary.
    """
    return summarize(latency_cells(logs, "release_version"), "release_version").select(
        "release_version",
        F.col("avg_ms").alias("avg_latency"),
        round_table(F.col("p95_ms")).alias("p95_latency"),
        F.col("error_rate"),
    )
