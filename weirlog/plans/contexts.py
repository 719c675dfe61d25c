"""Compact JSON metric documents.

Documents hold figures of aggregated tables, never log rows. One-row parts are put
together as scalar subqueries, keyed parts by equi-joins on the aggregated tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.compare import regressions_by_name
from ..operators.explore import slowest_endpoints
from ..operators.filters import filter_logs
from ..operators.metrics import (
    KPI_COLUMNS,
    LATENCY,
    counts_of_sets,
    endpoint_performance_of_cells,
    kpis,
    kpis_of_cells,
    latency_cells,
    region_performance_of_cells,
    release_performance_of_cells,
)
from ..sources.shared import durable

ALL_SERVICES = "all services"
ALL_RELEASES = "all releases"

_RELEASE = ("release_version", "requests", "avg_latency_ms", "p95_latency_ms", "p99_latency_ms", "error_rate_percent")
_REGRESSION = (
    "release_version",
    "previous_release_version",
    "avg_latency_change_percent",
    "p95_latency_change_percent",
    "error_rate_change_points",
    "is_regression",
)
_ENDPOINT = (
    "endpoint",
    "service_name",
    "requests",
    "avg_latency_ms",
    "p95_latency_ms",
    "p99_latency_ms",
    "error_rate_percent",
    "status",
)
_REGION = (
    "server_region",
    "requests",
    "avg_latency_ms",
    "p95_latency_ms",
    "error_rate_percent",
    "availability_percent",
)


def to_document(*fields: Column | str) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def summary_context(logs: DataFrame, service: str | None = None, release: str | None = None) -> DataFrame:
    """KPI document of one service and/or release, or of everything."""
    figures = kpis(filter_logs(logs, service=service, release=release))
    return figures.select(
        to_document(
            *KPI_COLUMNS,
            F.lit(service or ALL_SERVICES).alias("service"),
            F.lit(release or ALL_RELEASES).alias("release"),
        ).alias("context")
    )


def summary_contexts(logs: DataFrame) -> DataFrame:
    """KPI documents of every service x release, each service, each release and all.

    The log is aggregated once; the four groupings are made from its cells.
    """
    cells = latency_cells(logs, "service_name", "release_version")

    def level(service: Column, release: Column) -> Column:
        return F.struct(service.alias("service"), release.alias("release"))

    service, release = F.col("service_name"), F.col("release_version")
    every_service, every_release = F.lit(ALL_SERVICES), F.lit(ALL_RELEASES)
    levels = F.array(
        level(service, release),
        level(service, every_release),
        level(every_service, release),
        level(every_service, every_release),
    )
    spread = cells.withColumn("level", F.explode(levels)).select("*", "level.*").drop("level")
    figures = kpis_of_cells(spread, "service", "release")
    return figures.select("service", "release", to_document(*KPI_COLUMNS, "service", "release").alias("context"))


def _empty_kpis() -> Column:
    """The KPI bundle of a service without logs."""
    whole = {"total_requests", "slow_requests", "active_services", "failed_requests"}
    columns = []
    for name in KPI_COLUMNS:
        value = F.lit(0).cast("bigint") if name in whole else F.lit(100.0 if name == "availability_percent" else 0.0)
        columns.append(value.alias(name))
    return F.struct(*columns)


def incident_contexts(incidents: DataFrame, logs: DataFrame) -> DataFrame:
    """Document of each incident with the current KPIs of its service."""
    figures = kpis(logs, "service_name").select("service_name", F.struct(*KPI_COLUMNS).alias("figures"))
    joined = incidents.join(figures, incidents["service"] == figures["service_name"], "left")
    return joined.select(
        "id",
        to_document(
            F.col("title").alias("incident_title"),
            "trigger_type",
            "severity",
            "service",
            "description",
            F.coalesce(F.col("figures"), _empty_kpis()).alias("current_metrics"),
        ).alias("context"),
    )


def service_contexts(logs: DataFrame) -> DataFrame:
    """Document of each service: KPIs, release table, release-over-release check; one pass over the log."""
    cells = durable(latency_cells(logs, "service_name", "release_version"))
    figures = kpis_of_cells(cells, "service_name")
    figures = figures.select("service_name", F.struct(*KPI_COLUMNS).alias("current_metrics"))
    by_release = durable(release_performance_of_cells(cells, "service_name"))
    releases = by_release.groupBy("service_name").agg(
        F.array_sort(F.collect_list(F.struct(*_RELEASE))).alias("release_performance")
    )
    checks = (
        regressions_by_name(by_release, "service_name")
        .groupBy("service_name")
        .agg(F.array_sort(F.collect_list(F.struct(*_REGRESSION))).alias("regression_check"))
    )
    return (
        figures.join(releases, "service_name")
        .join(checks, "service_name")
        .select(
            F.col("service_name").alias("service"),
            to_document(
                F.col("service_name").alias("service"),
                "current_metrics",
                "release_performance",
                "regression_check",
            ).alias("context"),
        )
    )


def _listed(table: DataFrame, fields: tuple[str, ...], order: Column | None = None) -> Column:
    """A small aggregated table as one array of structs, as a scalar subquery."""
    row = F.struct(*fields)
    if order is None:
        items = F.array_sort(F.collect_list(row))
    else:
        keyed = F.sort_array(F.collect_list(F.struct(order.alias("key"), row.alias("row"))))
        items = F.transform(keyed, lambda item: item["row"])
    return table.agg(items.alias("items")).scalar()


def chat_context(logs: DataFrame) -> DataFrame:
    """One document with overall KPIs, services, slowest endpoints, releases and regions, from one pass over the log."""
    worst = F.struct((-F.col("p95_latency_ms")).alias("p95"), F.col("endpoint"), F.col("service_name"))
    sets = {"endpoint": ("endpoint", "service_name"), "release": ("release_version",), "region": ("server_region",)}
    counts = counts_of_sets(logs, {name: (*keys, LATENCY) for name, keys in sets.items()})
    cells = {name: counts.where(F.col("counted") == name) for name in sets}
    slowest = slowest_endpoints(endpoint_performance_of_cells(cells["endpoint"]), 10)
    return logs.sparkSession.range(1).select(
        to_document(
            kpis_of_cells(cells["endpoint"]).select(F.struct(*KPI_COLUMNS)).scalar().alias("overview"),
            _listed(kpis_of_cells(cells["endpoint"], "service_name"), ("service_name", *KPI_COLUMNS)).alias("services"),
            _listed(slowest, _ENDPOINT, worst).alias("slowest_endpoints"),
            _listed(release_performance_of_cells(cells["release"]), _RELEASE).alias("releases"),
            _listed(region_performance_of_cells(cells["region"]), _REGION).alias("regions"),
        ).alias("context")
    )
