"""Threshold incidents: detection, matching against open ones, life cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import detection_summary
from ..functions.numbers import fixed_text, percent_of, round_figure, round_table
from ..functions.status import is_error
from ..schema import DEFAULTS, INCIDENT_STATUSES, Thresholds
from ..sources.shared import durable
from .metrics import LATENCY, latency_cells, summarize, with_half


def thresholds(
    error_rate_percent: float | None = None,
    p95_latency_ms: float | None = None,
    latency_multiplier: float | None = None,
) -> Thresholds:
    """Limits to use; None and 0 mean the default."""
    return Thresholds(
        high_error_rate_percent=error_rate_percent or DEFAULTS.high_error_rate_percent,
        high_latency_p95_ms=p95_latency_ms or DEFAULTS.high_latency_p95_ms,
        latency_regression_multiplier=latency_multiplier or DEFAULTS.latency_regression_multiplier,
    )


def affected_endpoints(logs: DataFrame, top: int = 5) -> DataFrame:
    """The ``top`` endpoints of each service by rounded error rate, as an ordered list.

    Ties go by endpoint. Only the leading rows of each service survive the window
    before its list is collected.
    """
    return affected_of_cells(latency_cells(logs, "service_name", "endpoint"), "service_name", top=top)


def affected_of_cells(cells: DataFrame, *by: str, top: int = 5) -> DataFrame:
    """``affected_endpoints`` of every ``by`` group, from request counts that carry the endpoint."""
    rate = percent_of(F.sum(F.col("n_4xx") + F.col("n_5xx")), F.sum("n"))
    rates = cells.groupBy(*by, "endpoint").agg(round_table(rate).alias("error_rate_percent"))
    worst = Window.partitionBy(*by).orderBy(F.col("error_rate_percent").desc(), "endpoint")
    return (
        rates.withColumn("place", F.row_number().over(worst))
        .where(F.col("place") <= top)
        .groupBy(*by)
        .agg(F.sort_array(F.collect_list(F.struct("place", "endpoint"))).alias("ranked"))
        .select(*by, F.transform("ranked", lambda r: r["endpoint"]).alias("affected_endpoints"))
    )


def _violation(when: Column, title: str, severity: Column, trigger: str, description: Column) -> Column:
    """Struct of one violated rule, null where the rule holds. Texts are fixed values."""
    return F.when(
        when,
        F.struct(
            F.concat(F.lit(title), F.lit(" — "), F.col("service_name")).alias("title"),
            severity.alias("severity"),
            F.col("service_name").alias("service"),
            F.lit(trigger).alias("trigger_type"),
            description.alias("description"),
        ),
    )


def _affected_text() -> Column:
    names = F.concat_ws(", ", F.col("affected_endpoints"))
    return F.concat(F.lit("Affected endpoints: "), F.coalesce(F.nullif(names, F.lit("")), F.lit("n/a")), F.lit("."))


def high_error_rate(limit: float) -> Column:
    rate = F.col("error_rate")
    return _violation(
        rate > limit,
        "High Error Rate",
        F.when(rate > limit * 2, F.lit("high")).otherwise(F.lit("medium")),
        "high_error_rate",
        F.concat(
            F.lit("Error rate "),
            fixed_text(rate, 1),
            F.lit(f"% exceeds threshold {limit:.1f}%. "),
            _affected_text(),
        ),
    )


def high_latency(limit: float) -> Column:
    p95 = F.col("p95_ms")
    return _violation(
        p95 > limit,
        "High API Latency",
        F.when(p95 > limit * 1.5, F.lit("high")).otherwise(F.lit("medium")),
        "high_latency",
        F.concat(
            F.lit("P95 latency "),
            fixed_text(p95, 0),
            F.lit(f"ms exceeds threshold {limit:.0f}ms. "),
            _affected_text(),
        ),
    )


def sudden_latency_increase(multiplier: float) -> Column:
    old, new = F.col("baseline_avg_ms"), F.col("avg_ms")
    return _violation(
        (old > 0) & (new > old * multiplier),
        "Sudden Latency Increase",
        F.lit("high"),
        "sudden_latency_increase",
        F.concat(
            F.lit("Average latency jumped from "),
            fixed_text(old, 0),
            F.lit("ms to "),
            fixed_text(new, 0),
            F.lit(f"ms (>{multiplier}x baseline)."),
        ),
    )


def detect(logs: DataFrame, baseline: DataFrame | None = None, limits: Thresholds = DEFAULTS) -> DataFrame:
    """Every violated rule of every service.

    ``baseline`` is an earlier window of logs; without it the sudden-increase rule is
    skipped. The counts that all rules need are made in one pass over each log and kept.
    """
    cells = latency_cells(logs, *_CELL_KEYS).withColumn("is_current", F.lit(True))
    if baseline is not None:
        cells = cells.unionByName(latency_cells(baseline, *_CELL_KEYS).withColumn("is_current", F.lit(False)))
    return violations_of_cells(durable(cells), baseline is not None, limits)


def detect_in_later_half(logs: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    """Violated rules of the later half of the time range, with the earlier one as baseline, in one pass."""
    cells = durable(latency_cells(with_half(logs), *_CELL_KEYS, "is_current"))
    return violations_of_cells(cells, True, limits)


_CELL_KEYS = ("service_name", "endpoint")


def violations_of_cells(cells: DataFrame, with_baseline: bool, limits: Thresholds = DEFAULTS, by: tuple[str, ...] = ()) -> DataFrame:
    """Violated rules per ``by`` group and service, from counts per (by, service, endpoint, is_current, latency)."""
    keys = (*by, "service_name")
    now = cells.where("is_current")
    current = summarize(now, *keys).join(affected_of_cells(now, *keys), list(keys))
    rules = [high_error_rate(limits.high_error_rate_percent), high_latency(limits.high_latency_p95_ms)]
    if with_baseline:
        mean = F.sum(F.col(LATENCY) * F.col("n")) / F.sum("n")
        earlier = cells.where("NOT is_current").groupBy(*keys).agg(mean.alias("baseline_avg_ms"))
        current = current.join(earlier, list(keys), "left")
        rules.append(sudden_latency_increase(limits.latency_regression_multiplier))
    found = F.filter(F.array(*rules), lambda rule: rule.isNotNull())
    return current.select(*by, F.explode(found).alias("violation")).select(*by, "violation.*")


def as_incidents(violations: DataFrame, detected_at: Column) -> DataFrame:
    """Violations as new open incident rows. The id follows from content and time."""
    at = detected_at.cast("timestamp_ntz")
    return violations.withColumn("started_at", at).select(
        F.sha2(F.concat_ws("|", "service", "trigger_type", F.col("started_at").cast("string")), 256).alias("id"),
        "title",
        "severity",
        F.lit("open").alias("status"),
        "service",
        "started_at",
        F.lit(None).cast("timestamp_ntz").alias("ended_at"),
        "trigger_type",
        "description",
        F.col("started_at").alias("created_at"),
        F.col("started_at").alias("updated_at"),
    )


def _open_keys(existing: DataFrame) -> DataFrame:
    return existing.where(F.col("status") == "open").select("service", "trigger_type").distinct()


def newly_violated(violations: DataFrame, existing: DataFrame) -> DataFrame:
    """Violations without an open incident of the same service and rule."""
    return violations.join(_open_keys(existing), ["service", "trigger_type"], "left_anti")


def already_open(violations: DataFrame, existing: DataFrame) -> DataFrame:
    return violations.join(_open_keys(existing), ["service", "trigger_type"], "left_semi")


def detection_counts(violations: DataFrame, existing: DataFrame) -> DataFrame:
    """How many violations are new and how many already open, with the message shown."""
    keys = _open_keys(existing).withColumn("is_open", F.lit(True))
    matched = violations.join(keys, ["service", "trigger_type"], "left")
    return matched.agg(
        F.count_if(F.col("is_open").isNull()).alias("incidents_created"),
        F.count_if(F.col("is_open").isNotNull()).alias("incidents_already_open"),
    ).withColumn("message", detection_summary(F.col("incidents_created"), F.col("incidents_already_open")))


def newest_first(incidents: DataFrame) -> DataFrame:
    return incidents.orderBy(F.col("started_at").desc(), "id")


def recent(incidents: DataFrame, rows: int = 5) -> DataFrame:
    return newest_first(incidents).limit(rows)


def incident_get(incidents: DataFrame, incident_id: str | Column) -> DataFrame:
    return incidents.where(F.col("id") == incident_id)


def _folded(changes: DataFrame) -> DataFrame:
    """One row per incident: the last status, when it was set, and since when the incident is resolved without a break.

    Of changes of one instant the one later in the life cycle counts as the last.
    """
    stages = F.array(*[F.lit(s) for s in INCIDENT_STATUSES])
    steps = changes.select("id", "status", F.col("changed_at").cast("timestamp_ntz").alias("changed_at"))
    checked = F.when(F.col("status").isin(*INCIDENT_STATUSES), F.col("status")).otherwise(
        F.raise_error(F.concat(F.lit("invalid incident status: "), F.coalesce("status", F.lit("null")))).cast("string")
    )
    steps = steps.select("id", checked.alias("status"), "changed_at")
    order = F.struct("changed_at", F.array_position(stages, F.col("status")).alias("stage"))
    unresolved = F.max(F.when(F.col("status") != "resolved", order)).over(Window.partitionBy("id"))
    since = F.when((F.col("status") == "resolved") & (unresolved.isNull() | (order > unresolved)), F.col("changed_at"))
    steps = steps.withColumns({"order": order, "since": since, "reopened": unresolved.isNotNull()})
    return steps.groupBy("id").agg(
        F.max_by("status", "order").alias("new_status"),
        F.max("changed_at").alias("changed_at"),
        F.min("since").alias("resolved_at"),
        F.max("reopened").alias("reopened"),
    )


def update_status(incidents: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply status changes (id, status, changed_at); several of one incident in the order of their times.

    Resolving sets ``ended_at`` once; any other status clears it. A status outside
    the life cycle fails the job. Ids that no incident has change nothing here;
    ``require_known`` refuses them.
    """
    new, changed = F.col("new_status"), F.col("new_status").isNotNull()
    kept_end = F.when(~F.col("reopened"), F.col("ended_at"))
    ended = F.when(new == "resolved", F.coalesce(kept_end, "resolved_at"))
    return incidents.join(_folded(changes), "id", "left").select(
        "id",
        "title",
        "severity",
        F.when(changed, new).otherwise(F.col("status")).alias("status"),
        "service",
        "started_at",
        F.when(changed, ended).otherwise(F.col("ended_at")).alias("ended_at"),
        "trigger_type",
        "description",
        "created_at",
        F.when(changed, F.col("changed_at")).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def require_known(incidents: DataFrame, changes: DataFrame) -> None:
    """An error if a change names an incident that is not there."""
    unknown = changes.join(incidents.select("id"), "id", "left_anti").first()
    if unknown is not None:
        raise LookupError(f"incident {unknown['id']} not found")


def incident_context(incidents: DataFrame, logs: DataFrame) -> DataFrame:
    """Current figures and worst endpoints of each incident's service, from one pass over the log."""
    cells = durable(latency_cells(logs, *_CELL_KEYS))
    figures = summarize(cells, "service_name").select(
        "service_name",
        round_figure(F.col("error_rate")).alias("error_rate_percent"),
        round_figure(F.col("avg_ms")).alias("avg_latency_ms"),
        round_figure(F.col("p95_ms")).alias("p95_latency_ms"),
    )
    current = figures.join(affected_of_cells(cells, "service_name"), "service_name")
    zero, none = F.lit(0.0), F.array().cast("array<string>")
    return incidents.join(current, incidents["service"] == current["service_name"], "left").select(
        "id",
        "service",
        "trigger_type",
        F.coalesce("error_rate_percent", zero).alias("error_rate_percent"),
        F.coalesce("avg_latency_ms", zero).alias("avg_latency_ms"),
        F.coalesce("p95_latency_ms", zero).alias("p95_latency_ms"),
        F.coalesce("affected_endpoints", none).alias("affected_endpoints"),
    )


def incidents_of_windows(violations: DataFrame, changes: DataFrame) -> DataFrame:
    """Incidents that follow from the violations of event-time windows and the status changes made so far.

    ``violations`` has one row per (window_start, service, rule), ``changes`` has (id, status,
    changed_at). The id follows from service, rule and window. Of a service and rule the first
    violation is an incident. It blocks later windows as long as it is open: windows
    that start after it was acknowledged or resolved can open the next one. An
    incident that a change names stays, whatever late rows add before it. Both are
    folded over the violating windows of one service and rule, whose number is bounded by time.
    """
    at = F.col("window_start")
    rows = as_incidents(violations, at)
    free = F.when(F.col("new_status") != "open", F.col("changed_at"))
    named = rows.join(_folded(changes), "id", "left").withColumns(
        {"free_from": free, "named": F.col("new_status").isNotNull()}
    )
    step = F.struct("started_at", "free_from", "named", "id")
    grouped = named.groupBy("service", "trigger_type").agg(F.array_sort(F.collect_list(step)).alias("steps"))

    def fold(state, step):
        opens = state["free_from"].isNotNull() & (step["started_at"] >= state["free_from"])
        taken = step["named"] | (F.size(state["ids"]) == 0) | opens
        return F.struct(
            F.when(taken, F.concat(state["ids"], F.array(step["id"]))).otherwise(state["ids"]).alias("ids"),
            F.when(taken, step["free_from"]).otherwise(state["free_from"]).alias("free_from"),
        )

    nothing = F.struct(F.array().cast("array<string>").alias("ids"), F.lit(None).cast("timestamp_ntz").alias("free_from"))
    kept = grouped.select(F.explode(F.aggregate("steps", nothing, fold)["ids"]).alias("id"))
    return update_status(rows.join(kept, "id", "left_semi"), changes)
