"""The registered queries: each operator over the log views of a table folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import labels, status
from .functions.numbers import percent_change, round_figure, round_table
from .functions.status import is_error
from .functions.text import default_if_blank, normalize_endpoint
from .operators import cleaning, compare, explore, filters, incidents, metrics, outliers, quality, scores, sketches
from .plans import contexts, prompts
from .schema import LOG_COLUMNS, UNKNOWN, UNKNOWN_SERVICE
from .sources import csv_logs, sample_views, tables
from .sources.shared import durable, fresh_path
from .streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
Step = Callable[[DataFrame], DataFrame]


def _clean(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.clean(sample_views.raw_logs(spark, folder))


def _typed(spark: SparkSession, folder: str) -> DataFrame:
    return quality.typed(sample_views.raw_logs(spark, folder))


def _over(view: Query, steps: dict[str, Step]) -> dict[str, Query]:
    def bind(step: Step) -> Query:
        return lambda spark, folder: step(view(spark, folder))

    return {name: bind(step) for name, step in steps.items()}


def _list_text(*names: str) -> list:
    """Array columns as JSON text, so that results compare as plain values."""
    return [F.to_json(F.col(n), {"ignoreNullFields": "false"}).alias(n) for n in names]


def _day_text(step: Step, name: str) -> Step:
    """Days as ISO text, as they are published."""
    return lambda df: step(df).withColumn(name, F.col(name).cast("string"))


# Sources, sinks and datasets


def _with_store(action: Callable[[tables.LogTables, str], DataFrame]) -> Query:
    """The result of ``action`` on a database of its own, which is dropped when the result is kept."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        store = tables.LogTables(spark, f"weirlog_{uuid.uuid4().hex}", fresh_path(spark, "database"))
        try:
            return durable(action(store, folder))
        finally:
            spark.sql(f"DROP DATABASE {store.database} CASCADE")

    return run


def _csv_folder(spark: SparkSession, folder: str) -> str:
    path = fresh_path(spark, "csv")
    csv_logs.write_raw_csv(sample_views.raw_logs(spark, folder), path)
    return path


def _store_logs(store: tables.LogTables, folder: str) -> None:
    """The clean logs stored as two datasets: the v1 releases and the rest."""
    logs, first = sample_views.logs(store.spark, folder), F.col("release_version").startswith("v1.")
    store.persist_clean(logs.where(first), "ds-v1", "v1 releases", "v1.csv")
    store.persist_clean(logs.where(~first), "ds-v2", "later releases", "v2.csv")


def src_csv_raw(spark: SparkSession, folder: str) -> DataFrame:
    return csv_logs.read_raw_csv(spark, _csv_folder(spark, folder))


def _landed(store: tables.LogTables, folder: str) -> DataFrame:
    """Raw rows landed twice under one id."""
    raw = sample_views.raw_logs(store.spark, folder)
    store.land_raw(raw.limit(10), "ds-raw")
    return store.land_raw(raw, "ds-raw")


def _scanned(store: tables.LogTables, folder: str) -> DataFrame:
    _store_logs(store, folder)
    return store.scan("ds-v2").drop("log_id", "log_month")


def _replaced(store: tables.LogTables, folder: str) -> DataFrame:
    """All logs stored, then those of one year under the same id: only these remain."""
    logs = sample_views.logs(store.spark, folder)
    store.persist_clean(logs, "ds-logs", "all years", "all.csv")
    store.persist_clean(logs.where(F.year("timestamp") == 1996), "ds-logs", "one year", "1996.csv")
    registered = store.list_datasets().select("dataset_id", "row_count", "status")
    return store.scan("ds-logs").drop("log_id", "log_month").join(registered, "dataset_id")


def _ingested(store: tables.LogTables, folder: str) -> DataFrame:
    return store.ingest(_csv_folder(store.spark, folder)).drop("dataset_id")


def _ingested_twice(store: tables.LogTables, folder: str) -> DataFrame:
    """The answers of loading a file, and of loading it again without force; one dataset is stored."""
    path = _csv_folder(store.spark, folder)
    answers = [durable(store.ingest(path, force=False)) for _ in range(2)]
    n = store.list_datasets().count()
    return answers[0].union(answers[1]).drop("dataset_id").withColumn("datasets", F.lit(n).cast("bigint"))


def _ingested_folder(store: tables.LogTables, folder: str) -> DataFrame:
    """A file a release, one of them twice and one loaded before: how many files are loaded, and their rows."""
    spark, path = store.spark, fresh_path(store.spark, "csv")
    raw, before = sample_views.raw_logs(spark, folder), fresh_path(spark, "csv")
    for release in (None, "v1.0", "v1.1", "v2.0", "v1.0"):
        rows = raw.where(F.col("release_version").eqNullSafe(F.lit(release)))
        csv_logs.write_raw_csv(rows.coalesce(1), path, mode="append")
        if release == "v1.1":
            csv_logs.write_raw_csv(rows.orderBy(*LOG_COLUMNS), before)
            store.ingest(before)
    answer = durable(store.ingest_folder(path))
    return answer.groupBy("already_loaded").agg(
        F.count(F.lit(1)).alias("files"), F.count_distinct("dataset_id").alias("datasets"), F.sum("clean_rows").alias("clean_rows")
    )


def _listed_datasets(store: tables.LogTables, folder: str) -> DataFrame:
    _store_logs(store, folder)
    return store.list_datasets().drop("created_at")


def _after_delete(store: tables.LogTables, folder: str) -> DataFrame:
    _store_logs(store, folder)
    store.delete_dataset("ds-v1")
    return store.scan().drop("log_id", "log_month")


def _after_reset(store: tables.LogTables, folder: str) -> DataFrame:
    _store_logs(store, folder)
    return store.reset()


def _counted(report: Step, **choice) -> Query:
    """A report from stored counts, after one dataset was replaced and another deleted."""

    def action(store: tables.LogTables, folder: str) -> DataFrame:
        logs = sample_views.logs(store.spark, folder).where(F.year("timestamp") == 1995)
        for dataset in ("ds-v1", "ds-gone"):
            store.persist_clean(logs, dataset, "one year", "1995.csv")
        _store_logs(store, folder)
        store.delete_dataset("ds-gone")
        return report(store.counts(**choice))

    return _with_store(action)


SOURCES: dict[str, Query] = {
    "src_csv_raw": src_csv_raw,
    "src_raw_landing": _with_store(_landed),
    "src_logs_scan": _with_store(_scanned),
    "sink_clean_persist": _with_store(_replaced),
    "ds_ingest": _with_store(_ingested),
    "ds_ingest_idempotent": _with_store(_ingested_twice),
    "ds_ingest_folder": _with_store(_ingested_folder),
    "ds_list": _with_store(_listed_datasets),
    "ds_delete": _with_store(_after_delete),
    "ds_reset": _with_store(_after_reset),
}

# Cleaning and quality


def _field_values(column: str, cleaned) -> Step:
    """How often each raw value of a field occurs and what it becomes."""
    return lambda raw: raw.groupBy(column).agg(F.count(F.lit(1)).alias("n")).withColumn("cleaned", cleaned(column))


CLEANING = _over(
    sample_views.raw_logs,
    {
        "cln_coerce": cleaning.coerce,
        "cln_status_range": lambda raw: cleaning.keep_valid_status(cleaning.coerce(raw)),
        "cln_latency_positive": lambda raw: cleaning.keep_valid_latency(cleaning.coerce(raw)),
        "cln_timestamp_valid": lambda raw: cleaning.keep_valid_timestamp(cleaning.coerce(raw)),
        "cln_endpoint_norm": _field_values("endpoint", lambda c: normalize_endpoint(F.col(c))),
        "cln_service_default": _field_values("service_name", lambda c: default_if_blank(F.col(c), UNKNOWN_SERVICE)),
        "cln_release_default": _field_values("release_version", lambda c: default_if_blank(F.col(c), UNKNOWN)),
        "cln_region_default": _field_values("server_region", lambda c: default_if_blank(F.col(c), UNKNOWN)),
        "cln_int_truncate": lambda raw: cleaning.usable(raw)
        .groupBy("status_code", "response_time_ms")
        .agg(F.count(F.lit(1)).alias("n")),
        "cln_dedup": cleaning.deduplicate,
        "cln_report": cleaning.report,
        "cln_clean": cleaning.clean,
    },
)


def _day_first(spark: SparkSession, folder: str) -> DataFrame:
    """The raw logs as written where the day comes first."""
    swapped = F.regexp_replace("timestamp", r"^(\d{4})-(\d\d)-(\d\d)", "$3/$2/$1")
    return sample_views.raw_logs(spark, folder).withColumn("timestamp", swapped)


TIMES = _over(
    _day_first,
    {
        "cln_timestamp_formats": cleaning.timestamp_formats,
        "cln_coerce_day_first": lambda raw: cleaning.coerce(raw, "dd/MM/yyyy"),
        "cln_clean_day_first": lambda raw: cleaning.clean(raw, "dd/MM/yyyy"),
    },
)


def lq_raw_vs_clean(spark: SparkSession, folder: str) -> DataFrame:
    table = _typed(spark, folder)
    return quality.raw_vs_clean(table, quality.clean_stage1(table))


def _stage2(table: DataFrame) -> DataFrame:
    return quality.clean_stage2(quality.clean_stage1(table))


QUALITY = {
    "lq_raw_vs_clean": lq_raw_vs_clean,
    **_over(
        _typed,
        {
            "lq_row_count": quality.row_count,
            "lq_preview": quality.preview,
            "lq_null_profile": quality.null_profile,
            "lq_invalid_count": quality.invalid_count,
            "lq_clean_stage1": quality.clean_stage1,
            "lq_clean_stage2": _stage2,
            "lq_unknown_count": lambda table: quality.unknown_count(_stage2(table)),
            "lq_residual_nulls": lambda table: quality.residual_nulls(_stage2(table)),
        },
    ),
}

# Filters and projections


def _health_by_region(logs: DataFrame) -> DataFrame:
    keys = ("endpoint", "service_name", "server_region")
    table = metrics.summarize(metrics.latency_cells(logs, *keys), *keys)
    return table.select(*keys, status.health_class(F.col("error_rate"), F.col("p95_ms")).alias("status"))


def _service_health_by_region(logs: DataFrame) -> DataFrame:
    keys = ("service_name", "server_region")
    table = metrics.summarize(metrics.latency_cells(logs, *keys), *keys)
    grade = status.service_health(F.col("service_name"), round_figure(F.col("error_rate")), F.col("p95_ms"))
    return table.select(*keys, grade.alias("status"))


def _bands(logs: DataFrame) -> DataFrame:
    return metrics.kpis(logs, "service_name", "server_region").select(
        "service_name",
        "server_region",
        status.error_rate_band(F.col("error_rate_percent")).alias("error_band"),
        status.availability_band(F.col("availability_percent")).alias("availability_band"),
    )


def _changes_by_group(logs: DataFrame) -> DataFrame:
    """Change of failed requests from the earlier to the later half, old zeros included."""
    keys = ("service_name", "endpoint", "release_version", "server_region")
    failed, current = is_error(F.col("status_code")), F.col("is_current")
    halves = metrics.with_half(logs).groupBy(*keys)
    sums = halves.agg(
        F.count_if(failed & ~current).cast("double").alias("old"),
        F.count_if(failed & current).cast("double").alias("new"),
    )
    return sums.withColumn("change_percent", round_table(percent_change(F.col("old"), F.col("new"))))


def _release_changes(logs: DataFrame) -> DataFrame:
    return compare.regressions_by_name(metrics.release_performance(logs, "service_name"), "service_name")


def _labelled_changes(label) -> Step:
    def step(logs: DataFrame) -> DataFrame:
        return _release_changes(logs).select(
            "service_name",
            "release_version",
            label(F.col("error_rate_change_points"), "pt").alias("error_change"),
            label(F.col("avg_latency_change_percent"), "%").alias("latency_change"),
        )

    return step


def _verdicts(logs: DataFrame) -> DataFrame:
    verdict = status.regression_verdict(
        F.col("is_regression"), F.col("avg_latency_change_percent"), F.col("p95_latency_change_percent")
    )
    return _release_changes(logs).select("service_name", "release_version", verdict.alias("verdict"))


def _display_names(logs: DataFrame) -> DataFrame:
    return (
        logs.groupBy("service_name", "endpoint", "release_version", "server_region")
        .agg(F.count(F.lit(1)).alias("requests"))
        .select(
            labels.service_label(F.col("service_name")).alias("service"),
            labels.endpoint_label(F.col("endpoint")).alias("endpoint"),
            labels.release_label(F.col("release_version")).alias("release"),
            labels.region_label(F.col("server_region")).alias("region"),
            "requests",
        )
    )


FILTERS = _over(
    sample_views.logs,
    {
        "flt_logs": lambda logs: filters.filter_logs(
            logs, "order-service", "/api/v1/p3", "v2.0", "ASIA", "1996-01-01", "2000-12-31"
        ),
        "flt_status": lambda logs: filters.filter_logs(logs, status=503),
        "flt_release_in": lambda logs: filters.filter_releases(logs, " v1.0, ,v2.0 "),
        "flt_search": lambda logs: filters.search_endpoints(metrics.endpoint_performance(logs), "P1"),
        "prj_pct_change": _changes_by_group,
        "prj_status_class": _health_by_region,
        "prj_service_status": _service_health_by_region,
        "prj_kpi_bands": _bands,
        "prj_change_label": _labelled_changes(labels.change_label),
        "prj_change_cell": _labelled_changes(labels.change_cell),
        "prj_regression_verdict": _verdicts,
        "prj_seconds": lambda logs: metrics.endpoint_performance(logs).select(
            "endpoint", "service_name", labels.seconds_label(F.col("p95_latency_ms")).alias("p95")
        ),
    },
) | _over(_clean, {"prj_display_names": _display_names})

# Aggregates


def _service_detail(logs: DataFrame) -> DataFrame:
    detail = metrics.service_detail(logs)
    lists = ("endpoints", "releases", "regions", "latency_trend")
    return detail.select(*[c for c in detail.columns if c not in lists], *_list_text(*lists))


AGGREGATES = _over(
    sample_views.logs,
    {
        "agg_error_rate": metrics.error_rate,
        "agg_percentiles": metrics.percentiles,
        "agg_latency_metrics": metrics.latency_metrics,
        "agg_kpis": metrics.kpis,
        "agg_period_comparison": metrics.period_comparison,
        "agg_overview": metrics.overview,
        "agg_latency_trend": _day_text(metrics.latency_trend, "date"),
        "agg_endpoint_perf": metrics.endpoint_performance,
        "agg_release_perf": metrics.release_performance,
        "agg_region_perf": metrics.region_performance,
        "agg_service_summary": lambda logs: metrics.service_summary(logs).orderBy("service_name"),
        "agg_service_detail": _service_detail,
        "agg_service_endpoints": metrics.service_endpoints,
        "agg_service_breakdown": metrics.service_breakdown,
        "agg_endpoint_detail": metrics.endpoint_detail,
        "agg_endpoint_service_detail": lambda logs: metrics.endpoint_detail(logs, by_service=True),
        "agg_endpoint_breakdown": metrics.endpoint_breakdown,
        "agg_endpoint_trend": _day_text(metrics.endpoint_trend, "date"),
        "agg_kpis_by_service": lambda logs: metrics.kpis(logs, "service_name"),
        "agg_regions_list": metrics.regions_list,
        "lg_error_rate_by_endpoint": metrics.plain_error_rate_by_endpoint,
        "lg_daily_latency": _day_text(metrics.plain_daily_latency, "log_date"),
        "lg_release_perf": metrics.plain_release_performance,
    },
) | _over(_clean, {"agg_overview_cleaned": metrics.overview, "agg_endpoint_perf_cleaned": metrics.endpoint_performance})

STORED_COUNTS: dict[str, Query] = {
    "agg_overview_stored": _counted(metrics.overview, halves=True),
    "agg_kpis_stored_range": _counted(
        metrics.kpis, service="order-service", date_from="1996-03-05", date_to="1997-04-01 12:00:00"
    ),
    "agg_latency_trend_stored": _counted(_day_text(metrics.latency_trend, "date")),
    "agg_endpoint_perf_stored": _counted(metrics.endpoint_performance),
    "agg_service_detail_stored": _counted(_service_detail),
    "ctx_chat_stored": _counted(contexts.chat_context),
    "inc_detect_stored": _counted(incidents.detect_in_later_half, halves=True),
}

# Comparisons, outliers, scores


def _on_releases(step: Step) -> Step:
    return lambda logs: step(metrics.release_performance(logs))


def _population_zscores(logs: DataFrame) -> DataFrame:
    return outliers.population_zscore_outliers(logs).withColumn("z_score", round_table(F.col("z_score"), 6))


COMPARISONS = _over(
    sample_views.logs,
    {
        "win_release_regressions": _on_releases(lambda perf: compare.regressions(perf, "v1.0, v0.9, v1.1, v2.0")),
        "win_release_regressions_lex": _on_releases(compare.regressions_by_name),
        "win_release_regressions_by_service": _release_changes,
        "win_release_pair": _on_releases(compare.release_pair),
        "win_release_stability": _on_releases(compare.release_stability),
        "rel_compare": lambda logs: compare.compare_releases(
            filters.filter_logs(logs, service="user-service"), "v1.0,v2.0"
        ),
        "win_ntile_p95": compare.top_bucket,
        "out_iqr": outliers.iqr_outliers,
        "out_p99": outliers.p99_outliers,
        "out_zscore": outliers.zscore_outliers,
        "out_dispatch": lambda logs: outliers.outlier_page(logs, "p99", service="order-service"),
        "lg_out_zscore_pop": _population_zscores,
        "lg_out_endpoint_p95": outliers.endpoint_p95_outliers,
        "scr_reliability": lambda logs: scores.reliability_scores(logs, "service_name"),
        "scr_reliability_by_endpoint": lambda logs: scores.reliability_scores(logs, "service_name", "endpoint"),
        "lg_stability_top10": scores.least_stable_endpoints,
    },
)

# Incidents


def _violations(logs: DataFrame) -> DataFrame:
    return incidents.detect_in_later_half(logs)


def _earlier_incidents(logs: DataFrame) -> DataFrame:
    """Incidents found in the earlier half; latency ones acknowledged, one service's resolved."""
    found = incidents.as_incidents(incidents.detect(metrics.earlier_half(logs)), metrics.middle_of_range(logs))
    resolved = F.col("service") == UNKNOWN_SERVICE
    state = (
        F.when(F.col("trigger_type") == "high_latency", F.lit("acknowledged"))
        .when(resolved, F.lit("resolved"))
        .otherwise(F.col("status"))
    )
    return durable(found.withColumns({"status": state, "ended_at": F.when(resolved, F.col("started_at"))}))


def _all_incidents(logs: DataFrame) -> DataFrame:
    """The incident table after a detection run: small, and stored before it is used."""
    existing = _earlier_incidents(logs)
    new = incidents.newly_violated(_violations(logs), existing)
    created = incidents.as_incidents(new, logs.agg(F.max("timestamp")).scalar())
    return durable(existing.unionByName(created))


def _updated_incidents(logs: DataFrame) -> DataFrame:
    """Resolve all latency incidents, first acknowledging those open; reopen resolved ones; other incidents stay."""
    table = _all_incidents(logs)
    wanted = F.when(F.col("status") == "resolved", F.lit("open")).when(
        F.col("trigger_type").isin("high_latency", "sudden_latency_increase"), F.lit("resolved")
    )
    at = F.lit("2002-01-01 00:00:00")
    changes = table.select("id", wanted.alias("status"), at.alias("changed_at")).where(F.col("status").isNotNull())
    seen = table.where(F.col("status") == "open").join(changes.select("id"), "id", "left_semi")
    seen = seen.select("id", F.lit("acknowledged").alias("status"), F.lit("2001-12-31 00:00:00").alias("changed_at"))
    return incidents.update_status(table, changes.unionByName(seen))


def _affected(logs: DataFrame) -> DataFrame:
    return incidents.affected_endpoints(logs).select("service_name", *_list_text("affected_endpoints"))


def _one_rule(trigger: str) -> Step:
    return lambda logs: incidents.detect(logs).where(F.col("trigger_type") == trigger)


def _context_rows(logs: DataFrame) -> DataFrame:
    rows = incidents.incident_context(_all_incidents(logs), logs)
    return rows.select(*[c for c in rows.columns if c != "affected_endpoints"], *_list_text("affected_endpoints"))


def _open_twins(logs: DataFrame) -> DataFrame:
    return incidents.already_open(_violations(logs), _earlier_incidents(logs))


def _first_incident(logs: DataFrame) -> DataFrame:
    table = _all_incidents(logs)
    return incidents.incident_get(table, table.agg(F.min("id")).scalar())


INCIDENTS = _over(
    sample_views.logs,
    {
        "inc_affected_endpoints": _affected,
        "inc_high_error_rate": _one_rule("high_error_rate"),
        "inc_high_latency": _one_rule("high_latency"),
        "inc_sudden_latency": lambda logs: _violations(logs).where(
            F.col("trigger_type") == "sudden_latency_increase"
        ),
        "inc_detect": _violations,
        "inc_detect_overrides": lambda logs: incidents.detect(logs, limits=incidents.thresholds(0, 600.0, None)),
        "inc_dedup_open": lambda logs: incidents.newly_violated(_violations(logs), _earlier_incidents(logs)),
        "inc_already_open": _open_twins,
        "inc_detect_summary": lambda logs: incidents.detection_counts(_violations(logs), _earlier_incidents(logs)),
        "inc_list": lambda logs: incidents.newest_first(_all_incidents(logs)),
        "inc_get": _first_incident,
        "inc_recent5": lambda logs: incidents.recent(_all_incidents(logs)),
        "inc_status_update": _updated_incidents,
        "inc_context": _context_rows,
    },
)

# Log pages, lookups, rankings


def _first_log(logs: DataFrame) -> DataFrame:
    with_id = explore.with_log_id(logs)
    wanted = with_id.orderBy(*LOG_COLUMNS).limit(1).select("log_id").scalar()
    return explore.log_get(with_id, wanted).drop("log_id")


def _walked_pages(logs: DataFrame) -> DataFrame:
    """Pages 1 to 5 of different rows, each found from the last row of the one before."""
    rows, page = explore.with_log_id(logs.distinct()), None
    walked = []
    for number in range(1, 6):
        page = explore.next_page(rows, page, limit=50)
        walked.append(page.withColumn("page", F.lit(number)))
    return reduce(DataFrame.unionByName, walked).drop("log_id")


EXPLORE = _over(
    sample_views.logs,
    {
        "log_page": lambda logs: explore.log_page(filters.filter_logs(logs, service="user-service"), page=3, limit=50),
        "log_page_after": _walked_pages,
        "log_page_far": lambda logs: explore.log_page(logs, page=500, limit=25),
        "log_get": _first_log,
        "log_page_count": explore.page_count,
        "top5_services_error": lambda logs: explore.top_services_by_error(metrics.service_summary(logs)),
        "top5_slowest_endpoints": lambda logs: explore.slowest_endpoints(metrics.endpoint_performance(logs)),
        "top10_slowest_endpoints": lambda logs: explore.slowest_endpoints(metrics.endpoint_performance(logs), 10),
    },
)

# Documents and text


def _conversations(spark: SparkSession, folder: str) -> DataFrame:
    return sample_views.table(spark, folder, "conversations")


def _answers(conversations: DataFrame) -> DataFrame:
    """Turns dressed as model answers: bare, fenced, listed, and objects with text after."""
    causes = F.to_json(F.struct(F.array("text", "role").alias("potential_causes")))
    both = F.to_json(
        F.struct(F.array("text").alias("potential_causes"), F.array("role").alias("recommended_investigation"))
    )
    shape = F.pmod("conv_id", F.lit(5))
    answer = (
        F.when(shape == 0, F.col("text"))
        .when(shape == 1, F.concat(F.lit(" ```json\n"), both, F.lit("\n```\n")))
        .when(shape == 2, causes)
        .when(shape == 3, F.to_json(F.array("text")))
        .otherwise(F.concat(both, F.lit(" hope this helps")))
    )
    return conversations.select("conv_id", "turn", answer.alias("answer"))


def _parsed_answers(conversations: DataFrame) -> DataFrame:
    parsed = _answers(conversations).withColumn("parsed", prompts.parse_answer(F.col("answer")))
    lists = parsed.select("conv_id", "turn", "parsed.*")
    return lists.select("conv_id", "turn", *_list_text("potential_causes", "recommended_investigation"))


def _prompts(logs: DataFrame) -> DataFrame:
    """Summary, incident and service prompts of everything there is."""
    summaries = contexts.summary_contexts(logs).select(
        F.lit("summary").alias("kind"),
        F.concat_ws(" / ", "service", "release").alias("subject"),
        prompts.summary_prompt(F.col("context")).alias("prompt"),
    )
    about_incidents = contexts.incident_contexts(_all_incidents(logs), logs).select(
        F.lit("incident"), F.col("id"), prompts.incident_prompt(F.col("context"))
    )
    services = contexts.service_contexts(logs).select(
        F.lit("service"), F.col("service"), prompts.service_prompt(F.col("context"))
    )
    return summaries.union(about_incidents).union(services)


def txt_prompt_chat(spark: SparkSession, folder: str) -> DataFrame:
    """A prompt for the last user turn of each conversation, its earlier turns first, about the metrics of all logs."""
    document = contexts.chat_context(sample_views.logs(spark, folder)).scalar()
    asked = prompts.questions_with_history(_conversations(spark, folder))
    prompt = prompts.chat_prompt(F.col("question"), document, F.col("history"))
    return asked.select("conv_id", "turn", prompt.alias("prompt"))


DOCUMENTS = (
    {"txt_prompt_chat": txt_prompt_chat}
    | _over(
        sample_views.logs,
        {
            "ctx_summary": contexts.summary_contexts,
            "ctx_summary_filtered": lambda logs: contexts.summary_context(logs, "user-service", "v2.0"),
            "ctx_incident": lambda logs: contexts.incident_contexts(_all_incidents(logs), logs),
            "ctx_service": contexts.service_contexts,
            "ctx_chat": contexts.chat_context,
            "txt_prompt": _prompts,
        },
    )
    | _over(_conversations, {"txt_history": prompts.history, "json_response_parse": _parsed_answers})
)

# Streams: run to the end of what is there, then read what they wrote


def _run(stream: DataFrame, action: jobs.Batch) -> None:
    jobs.run_available(jobs.for_each_batch(stream, action, fresh_path(stream.sparkSession, "progress")))


def st_clean(spark: SparkSession, folder: str) -> DataFrame:
    out = fresh_path(spark, "stream-clean")
    _run(jobs.clean_stream(sample_views.raw_log_stream(spark, folder)), jobs.add_clean_rows_to(out))
    return jobs.clean_rows(spark, out)


def _streamed_cells(spark: SparkSession, folder: str, *keys: str) -> DataFrame:
    out = fresh_path(spark, "stream-cells")
    _run(sample_views.log_stream(spark, folder), jobs.add_cells_to(out, lambda logs: jobs.cells_of_days(logs, *keys)))
    return jobs.current_cells(spark, out)


def st_daily_trend(spark: SparkSession, folder: str) -> DataFrame:
    return _day_text(jobs.daily_trend_of, "date")(_streamed_cells(spark, folder))


def st_kpis(spark: SparkSession, folder: str) -> DataFrame:
    return _day_text(jobs.daily_kpis_of, "day")(_streamed_cells(spark, folder, "service_name"))


def st_incidents(spark: SparkSession, folder: str) -> DataFrame:
    """Incidents of windows of a day; every error-rate incident was acknowledged ten days after it began."""
    out, none = fresh_path(spark, "stream-incidents"), spark.createDataFrame([], "id string, status string, changed_at timestamp_ntz")
    _run(jobs.clean_stream(sample_views.raw_log_stream(spark, folder)), jobs.add_window_cells_to(out, "1 day"))
    first = jobs.window_incidents(spark, out, none).where(F.col("trigger_type") == "high_error_rate")
    ten_days = F.expr("started_at + INTERVAL 10 DAYS")
    changes = durable(first.select("id", F.lit("acknowledged").alias("status"), ten_days.alias("changed_at")))
    return jobs.window_incidents(spark, out, changes)


def st_daily_trend_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Days that the watermark has passed, as an event-time aggregate gives them out."""
    out, progress = fresh_path(spark, "stream-windows"), fresh_path(spark, "progress")
    jobs.run_available(jobs.append_to(jobs.daily_trend_stream(sample_views.log_stream(spark, folder)), out, progress))
    return _day_text(lambda df: df, "date")(spark.read.parquet(out))


def st_kpis_sketched(spark: SparkSession, folder: str) -> DataFrame:
    """KPIs per service from merged sketches of its days, and whether ranks of quantiles are off by less than one in a hundred."""
    out, keys = fresh_path(spark, "stream-sketches"), ("service_name",)
    _run(sample_views.log_stream(spark, folder), jobs.add_sketches_to(out, *keys))
    merged = durable(sketches.merge_sketches(jobs.current_sketches(spark, out, *keys), *keys))
    figures = sketches.figures_of_sketches(merged, *keys)
    errors = sketches.rank_errors(figures, sample_views.logs(spark, folder), *keys)
    close = errors.groupBy(*keys).agg(F.bool_and(F.col("rank_error") < 0.01).alias("ranks_close"))
    approximate = [f"{name}_latency_ms" for name in sketches.QUANTILES]
    return figures.drop(*approximate).join(close, list(keys))


STREAMS: dict[str, Query] = {
    "st_clean": st_clean,
    "st_daily_trend": st_daily_trend,
    "st_daily_trend_windows": st_daily_trend_windows,
    "st_kpis": st_kpis,
    "st_kpis_sketched": st_kpis_sketched,
    "st_incidents": st_incidents,
}

ALL: dict[str, Query] = {
    **SOURCES,
    **CLEANING,
    **TIMES,
    **QUALITY,
    **FILTERS,
    **AGGREGATES,
    **STORED_COUNTS,
    **COMPARISONS,
    **INCIDENTS,
    **EXPLORE,
    **DOCUMENTS,
    **STREAMS,
}
