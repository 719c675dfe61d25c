"""SQL twins of the registered queries, for DuckDB over the same tables.

Each statement spells out its operator directly (plain group-bys over rows, window
functions, quantile_cont), not the way the Spark side computes it.
"""

from __future__ import annotations

from .functions import times
from .plans import prompts
from .schema import LOG_COLUMNS
from .sources.sample_views import CLEAN_COLUMNS, RAW_COLUMNS

LOG = ", ".join(LOG_COLUMNS)
WS = r"'^\s+|\s+$', '', 'g'"


def fig(x: str, digits: int = 2) -> str:
    """Figure rounding: exact binary value, half-to-even."""
    return f"CAST(printf('%.{digits}f', {x}) AS DOUBLE)"


def cell(x: str, digits: int = 2) -> str:
    """Table rounding."""
    return f"round_even(({x}) * 1e{digits}, 0) / 1e{digits}"


def p(q: float) -> str:
    return f"quantile_cont(response_time_ms, {q})"


N = "count(*)"
AVG = "avg(response_time_ms)"
MAX = "CAST(max(response_time_ms) AS DOUBLE)"
ERR = "(CAST(count(*) FILTER (WHERE status_code >= 400) AS DOUBLE) / count(*) * 100)"
ERR4 = "(CAST(count(*) FILTER (WHERE status_code BETWEEN 400 AND 499) AS DOUBLE) / count(*) * 100)"
ERR5 = "(CAST(count(*) FILTER (WHERE status_code >= 500) AS DOUBLE) / count(*) * 100)"


def health(err: str, p95: str) -> str:
    return (
        f"CASE WHEN {err} > 5 OR {p95} > 2000 THEN 'Critical' "
        f"WHEN {err} > 2 OR {p95} > 1000 THEN 'Degraded' ELSE 'Healthy' END"
    )


def service_health(err: str, p95: str) -> str:
    return f"CASE WHEN service_name = 'unknown-service' THEN 'Unknown' ELSE {health(err, p95)} END"


# Views

VIEWS = {
    "raw": f"""
        SELECT {", ".join(RAW_COLUMNS)} FROM (
          SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM events
          UNION ALL
          SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM events WHERE event_id % 20 = 0)""",
    "coerced": """
        SELECT try_cast(timestamp AS TIMESTAMP) AS timestamp, service_name, endpoint,
               try_cast(status_code AS DOUBLE) AS status_code, try_cast(response_time_ms AS DOUBLE) AS response_time_ms,
               release_version, server_region FROM raw""",
    "usable": f"""
        SELECT timestamp,
          coalesce(nullif(regexp_replace(service_name, {WS}), ''), 'unknown-service') AS service_name,
          CASE WHEN endpoint IS NULL OR regexp_replace(endpoint, {WS}) = '' THEN 'unknown-endpoint'
               WHEN lower(regexp_replace(endpoint, {WS})) = '/' THEN '/'
               ELSE regexp_replace(lower(regexp_replace(endpoint, {WS})), '/+$', '') END AS endpoint,
          CAST(trunc(status_code) AS INT) AS status_code, CAST(trunc(response_time_ms) AS BIGINT) AS response_time_ms,
          coalesce(nullif(regexp_replace(release_version, {WS}), ''), 'unknown') AS release_version,
          coalesce(nullif(regexp_replace(server_region, {WS}), ''), 'unknown') AS server_region
        FROM coerced WHERE status_code BETWEEN 200 AND 599 AND response_time_ms > 0 AND timestamp IS NOT NULL""",
    "cleaned": "SELECT DISTINCT * FROM usable",
    "typed": """
        SELECT try_cast(timestamp AS TIMESTAMP) AS timestamp, service_name, endpoint,
               try_cast(status_code AS INT) AS status_code, try_cast(response_time_ms AS INT) AS response_time_ms,
               release_version, server_region FROM raw""",
    "stage1": """
        SELECT DISTINCT timestamp, coalesce(service_name, 'unknown_service') AS service_name,
               lower(trim(endpoint)) AS endpoint, status_code, response_time_ms,
               coalesce(release_version, 'unknown') AS release_version,
               coalesce(server_region, 'unknown') AS server_region
        FROM typed WHERE status_code BETWEEN 200 AND 599 AND response_time_ms > 0""",
    "stage2": """
        SELECT DISTINCT timestamp, coalesce(service_name, 'unknown-service') AS service_name,
               CASE WHEN endpoint IS NULL OR endpoint = '' THEN 'unknown-endpoint' ELSE lower(trim(endpoint)) END
                 AS endpoint, status_code, response_time_ms,
               coalesce(release_version, 'unknown') AS release_version,
               coalesce(server_region, 'unknown') AS server_region
        FROM stage1 WHERE status_code BETWEEN 200 AND 599 AND response_time_ms > 0""",
    "logs": f"""
        SELECT {", ".join(CLEAN_COLUMNS)}
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "mid": "SELECT epoch_us(min(timestamp)) + epoch_us(max(timestamp)) AS lohi, max(timestamp) AS last FROM logs",
    "halves": "SELECT logs.*, 2 * epoch_us(timestamp) >= lohi AS is_current FROM logs, mid",
    "current": f"SELECT {LOG} FROM halves WHERE is_current",
    "previous": f"SELECT {LOG} FROM halves WHERE NOT is_current",
}
USES = {
    "coerced": ["raw"],
    "usable": ["coerced"],
    "cleaned": ["usable"],
    "typed": ["raw"],
    "stage1": ["typed"],
    "stage2": ["stage1"],
    "mid": ["logs"],
    "halves": ["mid"],
    "current": ["halves"],
    "previous": ["halves"],
}


def over(views: str, body: str, **ctes: str) -> str:
    """``body`` with the named views (and what they use) and further CTEs before it."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for used in USES.get(name, []):
            need(used)
        if name not in ordered:
            ordered.append(name)

    for name in views.split():
        need(name)
    parts = [f"{n} AS ({VIEWS[n]})" for n in ordered] + [f"{n} AS ({sql})" for n, sql in ctes.items()]
    return f"WITH {', '.join(parts)} {body}"


def kpi_columns(active: str = "count(DISTINCT service_name)") -> str:
    return f"""count(*) AS total_requests, {fig(ERR)} AS error_rate_percent, {fig(AVG)} AS avg_latency_ms,
        {fig(p(0.95))} AS p95_latency_ms, {fig(p(0.99))} AS p99_latency_ms,
        {fig("100 - " + ERR)} AS availability_percent,
        count(*) FILTER (WHERE response_time_ms > 1000) AS slow_requests, {active} AS active_services,
        count(*) FILTER (WHERE status_code >= 400) AS failed_requests,
        {fig(ERR4)} AS error_rate_4xx_percent, {fig(ERR5)} AS error_rate_5xx_percent"""


KPI_NAMES = (
    "total_requests error_rate_percent avg_latency_ms p95_latency_ms p99_latency_ms availability_percent "
    "slow_requests active_services failed_requests error_rate_4xx_percent error_rate_5xx_percent"
).split()


def struct(names: list[str] | str) -> str:
    names = names.split() if isinstance(names, str) else names
    return "{" + ", ".join(f"'{n}': {n}" for n in names) + "}"


def json(value: str) -> str:
    return f"CAST(to_json({value}) AS VARCHAR)"


def change_columns(source: str) -> str:
    err = "CAST(count(*) FILTER (WHERE status_code >= 400 AND {0}) AS DOUBLE) / count(*) FILTER (WHERE {0}) * 100"
    avg = "avg(response_time_ms) FILTER (WHERE {0})"
    old, new = "NOT is_current", "is_current"
    a, b = avg.format(old), avg.format(new)
    return f"""SELECT {fig(f"({err.format(new)}) - ({err.format(old)})")} AS error_rate_change_points,
        {fig(f"({b} - {a}) / {a} * 100")} AS avg_latency_change_percent FROM {source}"""


TABLE = {
    "avg_latency_ms": cell(AVG),
    "p95_latency_ms": cell(p(0.95)),
    "p99_latency_ms": cell(p(0.99)),
    "max_latency_ms": MAX,
    "error_rate_percent": cell(ERR),
    "availability_percent": cell("100 - " + ERR),
}


def columns(*names: str) -> str:
    return ", ".join(f"{TABLE[n]} AS {n}" for n in names)


ENDPOINT = f"""count(*) AS requests, {columns("avg_latency_ms", "p95_latency_ms", "p99_latency_ms", "error_rate_percent")},
    {health(ERR, p(0.95))} AS status"""
RELEASE = (
    f"count(*) AS requests, {columns('avg_latency_ms', 'p95_latency_ms', 'p99_latency_ms', 'error_rate_percent')}"
)
REGION = (
    "count(*) AS requests, "
    f"{columns('avg_latency_ms', 'p95_latency_ms', 'error_rate_percent', 'availability_percent')}"
)
TREND = columns("avg_latency_ms", "p95_latency_ms", "p99_latency_ms", "max_latency_ms")
ENDPOINT_PERF = f"SELECT endpoint, service_name, {ENDPOINT} FROM logs GROUP BY ALL"
RELEASE_PERF = f"SELECT release_version, {RELEASE} FROM logs GROUP BY ALL"
RELEASE_PERF_BY_SERVICE = f"SELECT service_name, release_version, {RELEASE} FROM logs GROUP BY ALL"
REGION_PERF = f"SELECT server_region, {REGION} FROM logs GROUP BY ALL"
SERVICE_SUMMARY = f"""SELECT service_name, {service_health(fig(ERR), p(0.95))} AS status, count(*) AS total_requests,
    {fig(AVG)} AS avg_latency_ms, {fig(p(0.95))} AS p95_latency_ms, {fig(ERR)} AS error_rate_percent,
    {fig("100 - " + ERR)} AS availability_percent FROM logs GROUP BY service_name"""


def regressions(perf: str, by: str = "", order: str = "release_version") -> str:
    over_ = f"OVER (PARTITION BY {by} ORDER BY {order})" if by else f"OVER (ORDER BY {order})"
    lead = f"{by}, " if by else ""

    def was(c: str) -> str:
        return f"lag({c}) {over_}"

    avg, p95 = [f"({c} - {was(c)}) / {was(c)} * 100" for c in ("avg_latency_ms", "p95_latency_ms")]
    points = f"(error_rate_percent - {was('error_rate_percent')})"
    return f"""SELECT {lead}release_version, {was("release_version")} AS previous_release_version,
        coalesce({cell(avg)}, 0.0) AS avg_latency_change_percent,
        coalesce({cell(p95)}, 0.0) AS p95_latency_change_percent,
        coalesce({cell(points)}, 0.0) AS error_rate_change_points,
        coalesce({avg} > 20 OR {p95} > 20 OR {points} > 1.0, false) AS is_regression FROM {perf}"""


VERDICT = """CASE WHEN NOT is_regression THEN 'Stable'
    WHEN greatest(abs(avg_latency_change_percent), abs(p95_latency_change_percent)) > 50 THEN 'Regression'
    ELSE 'Minor Regression' END AS verdict"""


# Screen numbers: exact ties (odd quarters for one digit, odd eighths for two) go up.
def screen(x: str, digits: int) -> str:
    scale = 2 ** (digits + 1)
    tie = f"{x} * {scale} = floor({x} * {scale}) AND ({x} * {scale}) % 2 = 1"
    return f"printf('%.{digits}f', CASE WHEN {tie} THEN {x} + 1e-{digits + 1} ELSE {x} END)"


def change_label(x: str, unit: str) -> str:
    return f"""CASE WHEN abs({x}) < 0.05 THEN 'Flat vs previous period' ELSE
        (CASE WHEN {x} > 0 THEN '↑ ' ELSE '↓ ' END) || {screen(f"abs({x})", 1)} || '{unit} vs previous period' END"""


def change_cell(x: str, unit: str) -> str:
    sign = f"CASE WHEN {x} > 0 THEN '+' ELSE '' END"
    return f"CASE WHEN abs({x}) < 0.05 THEN '0{unit}' ELSE ({sign}) || printf('%.2f', {x}) || '{unit}' END"


def labelled(label) -> str:
    return over(
        "logs",
        f"""SELECT service_name, release_version, {label("error_rate_change_points", "pt")} AS error_change,
            {label("avg_latency_change_percent", "%")} AS latency_change FROM changes""",
        perf=RELEASE_PERF_BY_SERVICE,
        changes=regressions("perf", "service_name"),
    )


# Incidents


def affected(source: str) -> str:
    return f"""SELECT service_name, list(endpoint ORDER BY place) AS affected_endpoints FROM (
        SELECT service_name, endpoint, row_number() OVER (
            PARTITION BY service_name ORDER BY error_rate_percent DESC, endpoint) AS place
        FROM (SELECT service_name, endpoint, {cell(ERR)} AS error_rate_percent FROM {source} GROUP BY ALL))
        WHERE place <= 5 GROUP BY service_name"""


def detect(source: str, baseline: str | None = None, err: float = 5.0, p95: float = 1500) -> str:
    base = baseline or f"(SELECT * FROM {source} WHERE false)"
    listed = "'Affected endpoints: ' || array_to_string(affected_endpoints, ', ') || '.'"
    return f"""SELECT v.* FROM (
        SELECT service_name AS service, {ERR} AS err, {p(0.95)} AS p95, {AVG} AS avg_ms
        FROM {source} GROUP BY service_name) s
      JOIN ({affected(source)}) a ON a.service_name = s.service
      LEFT JOIN (SELECT service_name, {AVG} AS old_ms FROM {base} GROUP BY service_name) b ON b.service_name = s.service,
      LATERAL (
        SELECT 'High Error Rate — ' || service AS title, CASE WHEN err > {err} * 2 THEN 'high' ELSE 'medium' END AS severity,
               service, 'high_error_rate' AS trigger_type,
               'Error rate ' || printf('%.1f', err) || '% exceeds threshold {err:.1f}%. ' || {listed} AS description
        WHERE err > {err}
        UNION ALL
        SELECT 'High API Latency — ' || service, CASE WHEN p95 > {p95} * 1.5 THEN 'high' ELSE 'medium' END,
               service, 'high_latency',
               'P95 latency ' || printf('%.0f', p95) || 'ms exceeds threshold {p95:.0f}ms. ' || {listed}
        WHERE p95 > {p95}
        UNION ALL
        SELECT 'Sudden Latency Increase — ' || service, 'high', service, 'sudden_latency_increase',
               'Average latency jumped from ' || printf('%.0f', old_ms) || 'ms to ' || printf('%.0f', avg_ms) ||
               'ms (>1.5x baseline).'
        WHERE old_ms > 0 AND avg_ms > old_ms * 1.5) v"""


def detect_per_day(source: str, err: float = 5.0, p95: float = 1500) -> str:
    """The two rules without a baseline, for every day of ``source`` by itself."""
    listed = "'Affected endpoints: ' || array_to_string(affected_endpoints, ', ') || '.'"
    return f"""WITH dated AS (SELECT *, date_trunc('day', timestamp) AS day FROM {source}),
      worst AS (
        SELECT day, service_name, list(endpoint ORDER BY place) AS affected_endpoints FROM (
          SELECT *, row_number() OVER (PARTITION BY day, service_name ORDER BY error_rate_percent DESC, endpoint) AS place
          FROM (SELECT day, service_name, endpoint, {cell(ERR)} AS error_rate_percent FROM dated GROUP BY ALL))
        WHERE place <= 5 GROUP BY ALL),
      figures AS (SELECT day, service_name, {ERR} AS err, {p(0.95)} AS p95 FROM dated GROUP BY ALL)
      SELECT CAST(day AS TIMESTAMP) AS started_at, service_name AS service, 'High Error Rate — ' || service_name AS title,
        CASE WHEN err > {err} * 2 THEN 'high' ELSE 'medium' END AS severity, 'high_error_rate' AS trigger_type,
        'Error rate ' || printf('%.1f', err) || '% exceeds threshold {err:.1f}%. ' || {listed} AS description
      FROM figures JOIN worst USING (day, service_name) WHERE err > {err}
      UNION ALL
      SELECT CAST(day AS TIMESTAMP), service_name, 'High API Latency — ' || service_name,
        CASE WHEN p95 > {p95} * 1.5 THEN 'high' ELSE 'medium' END, 'high_latency',
        'P95 latency ' || printf('%.0f', p95) || 'ms exceeds threshold {p95:.0f}ms. ' || {listed}
      FROM figures JOIN worst USING (day, service_name) WHERE p95 > {p95}"""


def as_incidents(source: str, at: str) -> str:
    return f"""SELECT sha256(service || '|' || trigger_type || '|' || CAST({at} AS VARCHAR)) AS id, title, severity,
        'open' AS status, service, {at} AS started_at, CAST(NULL AS TIMESTAMP) AS ended_at, trigger_type, description,
        {at} AS created_at, {at} AS updated_at FROM {source}, mid"""


MIDDLE = "make_timestamp((lohi + 1) // 2)"
INCIDENT_TABLES = {
    "violations": detect("current", "previous"),
    "earlier": detect("previous"),
    "earlier_incidents": as_incidents("earlier", MIDDLE),
    "existing": """SELECT id, title, severity, CASE WHEN trigger_type = 'high_latency' THEN 'acknowledged'
        WHEN service = 'unknown-service' THEN 'resolved' ELSE status END AS status, service, started_at,
        CASE WHEN service = 'unknown-service' THEN started_at END AS ended_at, trigger_type, description,
        created_at, updated_at FROM earlier_incidents""",
    "blocked": "SELECT DISTINCT service, trigger_type FROM existing WHERE status = 'open'",
    "created": "SELECT * FROM violations ANTI JOIN blocked USING (service, trigger_type)",
    "all_incidents": f"SELECT * FROM existing UNION ALL {as_incidents('created', 'last')}",
}


def on_incidents(body: str, **ctes: str) -> str:
    return over("logs current previous", body, **INCIDENT_TABLES, **ctes)


# Documents

RELEASE_FIELDS = "release_version requests avg_latency_ms p95_latency_ms p99_latency_ms error_rate_percent"
REGRESSION_FIELDS = (
    "release_version previous_release_version avg_latency_change_percent p95_latency_change_percent "
    "error_rate_change_points is_regression"
)
ENDPOINT_FIELDS = (
    "endpoint service_name requests avg_latency_ms p95_latency_ms p99_latency_ms error_rate_percent status"
)
REGION_FIELDS = "server_region requests avg_latency_ms p95_latency_ms error_rate_percent availability_percent"

SUMMARIES = f"""SELECT service, release, {json(struct([*KPI_NAMES, "service", "release"]))} AS context FROM (
    SELECT coalesce(service_name, 'all services') AS service, coalesce(release_version, 'all releases') AS release,
           {kpi_columns("count(DISTINCT s)")}
    FROM (SELECT *, service_name AS s FROM logs) GROUP BY CUBE (service_name, release_version))"""
INCIDENT_DOCUMENT = (
    "{'incident_title': title, 'trigger_type': trigger_type, 'severity': severity, 'service': service, "
    "'description': description, 'current_metrics': " + struct(KPI_NAMES) + "}"
)
INCIDENT_DOCUMENTS = f"""SELECT id, {json(INCIDENT_DOCUMENT)} AS context
    FROM all_incidents JOIN service_kpis ON service = service_name"""
SERVICE_KPIS = f"SELECT service_name, {kpi_columns('1')} FROM logs GROUP BY service_name"
SERVICE_DOCUMENTS = f"""SELECT k.service_name AS service, {json(
    "{'service': k.service_name, 'current_metrics': " + struct(KPI_NAMES)
    + ", 'release_performance': release_performance, 'regression_check': regression_check}")} AS context
    FROM service_kpis k
    JOIN (SELECT service_name, list({struct(RELEASE_FIELDS)} ORDER BY release_version) AS release_performance
          FROM perf GROUP BY service_name) r USING (service_name)
    JOIN (SELECT service_name, list({struct(REGRESSION_FIELDS)} ORDER BY release_version) AS regression_check
          FROM changes GROUP BY service_name) c USING (service_name)"""
SERVICE_TABLES = {
    "service_kpis": SERVICE_KPIS,
    "perf": RELEASE_PERF_BY_SERVICE,
    "changes": regressions("perf", "service_name"),
}
CHAT = json(
    f"""{{'overview': (SELECT {struct(KPI_NAMES)} FROM (SELECT {kpi_columns()} FROM logs)),
    'services': (SELECT list({struct(["service_name", *KPI_NAMES])} ORDER BY service_name)
        FROM (SELECT service_name, {kpi_columns("1")} FROM logs GROUP BY service_name)),
    'slowest_endpoints': (SELECT list({struct(ENDPOINT_FIELDS)} ORDER BY p95_latency_ms DESC, endpoint, service_name)
        FROM (SELECT * FROM ({ENDPOINT_PERF}) ORDER BY p95_latency_ms DESC, endpoint, service_name LIMIT 10)),
    'releases': (SELECT list({struct(RELEASE_FIELDS)} ORDER BY release_version) FROM ({RELEASE_PERF})),
    'regions': (SELECT list({struct(REGION_FIELDS)} ORDER BY server_region) FROM ({REGION_PERF}))}}"""
)


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


ANSWERS = """SELECT conv_id, turn, CASE conv_id % 5
    WHEN 0 THEN text
    WHEN 1 THEN ' ```json' || chr(10) || both_lists || chr(10) || '```' || chr(10)
    WHEN 2 THEN CAST(to_json({'potential_causes': [text, role]}) AS VARCHAR)
    WHEN 3 THEN CAST(to_json([text]) AS VARCHAR)
    ELSE both_lists || ' hope this helps' END AS answer
  FROM (SELECT *, CAST(to_json({'potential_causes': [text], 'recommended_investigation': [role]}) AS VARCHAR)
        AS both_lists FROM conversations)"""
PARSED = r"""SELECT conv_id, turn,
    CAST(to_json(CASE WHEN ok THEN coalesce(CAST(json_extract(body, '$.potential_causes') AS VARCHAR[]), [])
         ELSE [answer] END) AS VARCHAR) AS potential_causes,
    CAST(to_json(CASE WHEN ok THEN coalesce(CAST(json_extract(body, '$.recommended_investigation') AS VARCHAR[]), [])
         ELSE CAST([] AS VARCHAR[]) END) AS VARCHAR) AS recommended_investigation
  FROM (SELECT *, CASE WHEN json_valid(body) THEN json_type(body) = 'OBJECT' ELSE false END AS ok FROM (
    SELECT conv_id, turn, answer, CASE WHEN lower(left(bare, 4)) = 'json' THEN substr(bare, 5) ELSE bare END AS body
    FROM (SELECT *, trim(regexp_replace(answer, '^\s+|\s+$', '', 'g'), '`') AS bare FROM answers)))"""


# Synthetic logs


def _u(digits: str, start: int, length: int) -> str:
    return f"(CAST(CAST('0x' || substr({digits}, {start}, {length}) AS BIGINT) AS DOUBLE) / {float(16**length)!r}e0)"


def _pick(values: tuple, u: str) -> str:
    items = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"CAST([{items}] AS VARCHAR[])[CAST(floor({u} * {len(values)}) AS INT) + 1]"


def _value_counts(column: str, default: str) -> str:
    cleaned = f"coalesce(nullif(regexp_replace({column}, {WS}), ''), '{default}')"
    return over("raw", f"SELECT {column}, count(*) AS n, {cleaned} AS cleaned FROM raw GROUP BY {column}")


def _quartiles() -> str:
    return f"SELECT {p(0.25)} AS q1, {p(0.75)} AS q3 FROM logs"


def statements() -> dict[str, str]:
    report = """count(*) AS raw_rows, (SELECT count(*) FROM cleaned) AS clean_rows,
        count(*) FILTER (WHERE NOT coalesce(status_code BETWEEN 200 AND 599, false)) AS dropped_invalid_status,
        count(*) FILTER (WHERE status_code BETWEEN 200 AND 599 AND NOT coalesce(response_time_ms > 0, false))
          AS dropped_invalid_latency,
        (SELECT count(*) FROM usable) - (SELECT count(*) FROM cleaned) AS duplicates_removed"""
    region_cells = over(
        "logs",
        f"""SELECT endpoint, service_name, server_region, {health(ERR, p(0.95))} AS status
            FROM logs GROUP BY ALL""",
    )
    by_dimension = {
        d: f"SELECT {{by}}, '{d}' AS dimension, {d} AS value, count(*) AS requests, {columns('avg_latency_ms', 'p95_latency_ms')}, "
        f"{'NULL' if d == 'server_region' else cell(p(0.99))} AS p99_latency_ms, {cell(ERR)} AS error_rate_percent, "
        f"{cell('100 - ' + ERR) if d == 'server_region' else 'NULL'} AS availability_percent, "
        f"{health(ERR, p(0.95)) if d == 'endpoint' else 'NULL'} AS status FROM logs GROUP BY {{by}}, {d}"
        for d in ("endpoint", "release_version", "server_region")
    }
    service_tables = " UNION ALL ".join(by_dimension[d].format(by="service_name") for d in by_dimension)
    endpoint_tables = " UNION ALL ".join(
        by_dimension[d].format(by="endpoint") for d in ("release_version", "server_region")
    )
    perf_regressions = over("logs", regressions("perf"), perf=RELEASE_PERF)
    reliability = f"""SELECT {{keys}}, {fig("l", 1)} AS latency_score, {fig("e", 1)} AS error_score,
        {fig("a", 1)} AS availability_score, overall AS overall_score,
        CASE WHEN overall < 60 THEN 'Critical' WHEN overall < 85 THEN 'Degraded' ELSE 'Healthy' END AS status
        FROM (SELECT *, {fig("l * 0.4e0 + e * 0.4e0 + a * 0.2e0", 1)} AS overall FROM (
          SELECT {{keys}}, least(greatest(100 - {p(0.95)} / 1500e0 * 100, 0e0), 100e0) AS l,
                 least(greatest(100 - {ERR} * 10, 0e0), 100e0) AS e, least(greatest(100 - {ERR}, 0e0), 100e0) AS a
          FROM logs GROUP BY {{keys}}))"""
    day = "CAST(CAST(timestamp AS DATE) AS VARCHAR)"
    trend = f"SELECT {day} AS date, {TREND} FROM logs GROUP BY date"
    fields = ["''", *(f"CAST({c} AS VARCHAR)" for c in LOG_COLUMNS)]
    log_id = f"md5({' || '.join(f"coalesce(length({f}) || ':' || {f}, '-')" for f in fields)})"
    incident_columns = (
        "id, title, severity, service, started_at, trigger_type, description, created_at"
    )
    sql = {
        # Sources, sinks and datasets
        "src_csv_raw": over(
            "raw",
            f"""SELECT timestamp, nullif(service_name, '') AS service_name, nullif(endpoint, '') AS endpoint,
                status_code, response_time_ms, release_version, server_region FROM raw""",
        ),
        "src_raw_landing": over("raw", f"SELECT {LOG} FROM raw"),
        "src_logs_scan": over(
            "logs", f"SELECT {LOG}, 'ds-v2' AS dataset_id FROM logs WHERE release_version NOT LIKE 'v1.%'"
        ),
        "sink_clean_persist": over(
            "logs",
            f"""SELECT {LOG}, 'ds-logs' AS dataset_id, count(*) OVER () AS row_count, 'cleaned' AS status FROM logs
                WHERE year(timestamp) = 1996""",
        ),
        "ds_ingest": over("cleaned", f"SELECT false AS already_loaded, {report} FROM coerced"),
        "ds_ingest_idempotent": over(
            "cleaned",
            """SELECT *, 1::BIGINT AS datasets FROM first
               UNION ALL BY NAME SELECT true AS already_loaded, clean_rows, 1::BIGINT AS datasets FROM first""",
            first=f"SELECT false AS already_loaded, {report} FROM coerced",
        ),
        "ds_ingest_folder": over(
            "cleaned",
            """SELECT release_version = 'v1.1' OR copy AS already_loaded, count(*)::BIGINT AS files,
                 count(DISTINCT release_version) AS datasets, sum(n)::BIGINT AS clean_rows
               FROM (SELECT release_version, count(*) AS n FROM cleaned GROUP BY release_version),
                 (SELECT unnest([false, true]) AS copy) WHERE NOT copy OR release_version = 'v1.0' GROUP BY ALL""",
        ),
        "ds_reset": over("logs", "SELECT count(*) AS logs_deleted, 2::BIGINT AS datasets_deleted FROM logs"),
        "ds_list": over(
            "logs",
            """SELECT CASE WHEN v1 THEN 'ds-v1' ELSE 'ds-v2' END AS dataset_id,
                 CASE WHEN v1 THEN 'v1 releases' ELSE 'later releases' END AS name,
                 CASE WHEN v1 THEN 'v1.csv' ELSE 'v2.csv' END AS file_name, count(*) AS row_count, 'cleaned' AS status
               FROM (SELECT release_version LIKE 'v1.%' AS v1 FROM logs) GROUP BY v1""",
        ),
        "ds_delete": over("logs", f"SELECT {LOG}, 'ds-v2' AS dataset_id FROM logs WHERE release_version NOT LIKE 'v1.%'"),
        # Cleaning and quality
        "cln_coerce": over("coerced", "SELECT * FROM coerced"),
        "cln_status_range": over("coerced", "SELECT * FROM coerced WHERE status_code BETWEEN 200 AND 599"),
        "cln_latency_positive": over("coerced", "SELECT * FROM coerced WHERE response_time_ms > 0"),
        "cln_timestamp_valid": over("coerced", "SELECT * FROM coerced WHERE timestamp IS NOT NULL"),
        "cln_endpoint_norm": over(
            "raw",
            f"""SELECT endpoint, count(*) AS n,
                CASE WHEN endpoint IS NULL OR regexp_replace(endpoint, {WS}) = '' THEN 'unknown-endpoint'
                     WHEN lower(regexp_replace(endpoint, {WS})) = '/' THEN '/'
                     ELSE regexp_replace(lower(regexp_replace(endpoint, {WS})), '/+$', '') END AS cleaned
                FROM raw GROUP BY endpoint""",
        ),
        "cln_service_default": _value_counts("service_name", "unknown-service"),
        "cln_release_default": _value_counts("release_version", "unknown"),
        "cln_region_default": _value_counts("server_region", "unknown"),
        "cln_int_truncate": over(
            "usable", "SELECT status_code, response_time_ms, count(*) AS n FROM usable GROUP BY ALL"
        ),
        "cln_dedup": over("raw", "SELECT DISTINCT * FROM raw"),
        "cln_report": over(
            "cleaned",
            f"""SELECT {report},
                (SELECT count(*) FROM usable WHERE endpoint = 'unknown-endpoint') AS unknown_endpoint_count,
                (SELECT count(*) FROM usable WHERE service_name = 'unknown-service') AS unknown_service_count
                FROM coerced""",
        ),
        "cln_clean": over("cleaned", "SELECT * FROM cleaned"),
        "cln_coerce_day_first": over("coerced", "SELECT * FROM coerced"),
        "cln_clean_day_first": over("cleaned", "SELECT * FROM cleaned"),
        "cln_timestamp_formats": over(
            "coerced",
            f"""SELECT format, CASE format WHEN 'dd/MM/yyyy' THEN n WHEN 'MM/dd/yyyy' THEN n_either ELSE 0 END AS n_values,
                  format = CASE WHEN first_day <= 12 THEN 'MM/dd/yyyy' ELSE 'dd/MM/yyyy' END AS is_used
                FROM (SELECT count(*) AS n, count(*) FILTER (WHERE day(timestamp) <= 12) AS n_either FROM coerced
                      WHERE timestamp IS NOT NULL),
                  (SELECT day(ts) AS first_day FROM events WHERE event_id % 97 <> 0 ORDER BY event_id LIMIT 1),
                  (SELECT unnest([{", ".join(map(text, times.FORMATS))}]) AS format)""",
        ),
        "lq_row_count": over("typed", "SELECT count(*) AS row_count FROM typed"),
        "lq_preview": over(
            "typed",
            "SELECT * FROM typed ORDER BY " + ", ".join(f"{c} ASC NULLS FIRST" for c in LOG_COLUMNS) + " LIMIT 5",
        ),
        "lq_null_profile": over(
            "typed",
            """SELECT count(*) FILTER (WHERE service_name IS NULL) AS null_service,
               count(*) FILTER (WHERE endpoint IS NULL OR endpoint = '') AS null_endpoint,
               count(*) FILTER (WHERE status_code IS NULL) AS null_status,
               count(*) FILTER (WHERE response_time_ms IS NULL) AS null_latency FROM typed""",
        ),
        "lq_invalid_count": over(
            "typed",
            "SELECT count(*) AS invalid_rows FROM typed WHERE status_code NOT BETWEEN 200 AND 599 OR response_time_ms <= 0",
        ),
        "lq_clean_stage1": over("stage1", "SELECT * FROM stage1"),
        "lq_clean_stage2": over("stage2", "SELECT * FROM stage2"),
        "lq_raw_vs_clean": over(
            "stage1",
            "SELECT (SELECT count(*) FROM typed) AS raw_rows, (SELECT count(*) FROM stage1) AS clean_rows",
        ),
        "lq_unknown_count": over(
            "stage2",
            """SELECT count(*) AS unknown_rows FROM stage2
               WHERE endpoint = 'unknown-endpoint' OR service_name = 'unknown-service'""",
        ),
        "lq_residual_nulls": over(
            "stage2", "SELECT count(*) AS null_rows FROM stage2 WHERE endpoint IS NULL OR service_name IS NULL"
        ),
        # Filters and projections
        "flt_logs": over(
            "logs",
            """SELECT * FROM logs WHERE service_name = 'order-service' AND endpoint = '/api/v1/p3'
               AND release_version = 'v2.0' AND server_region = 'ASIA'
               AND timestamp >= TIMESTAMP '1996-01-01' AND timestamp <= TIMESTAMP '2000-12-31'""",
        ),
        "flt_status": over("logs", "SELECT * FROM logs WHERE status_code = 503"),
        "flt_release_in": over("logs", "SELECT * FROM logs WHERE release_version IN ('v1.0', 'v2.0')"),
        "flt_search": over(
            "logs",
            """SELECT * FROM perf WHERE contains(lower(endpoint), 'p1') OR contains(lower(service_name), 'p1')""",
            perf=ENDPOINT_PERF,
        ),
        "prj_pct_change": over(
            "halves",
            f"""SELECT *, CASE WHEN old = 0 THEN 0e0 ELSE {cell("(new - old) / old * 100")} END AS change_percent FROM (
                SELECT service_name, endpoint, release_version, server_region,
                  CAST(count(*) FILTER (WHERE status_code >= 400 AND NOT is_current) AS DOUBLE) AS old,
                  CAST(count(*) FILTER (WHERE status_code >= 400 AND is_current) AS DOUBLE) AS new
                FROM halves GROUP BY ALL)""",
        ),
        "prj_status_class": region_cells,
        "prj_service_status": over(
            "logs",
            f"""SELECT service_name, server_region, {service_health(fig(ERR), p(0.95))} AS status
                FROM logs GROUP BY service_name, server_region""",
        ),
        "prj_kpi_bands": over(
            "logs",
            f"""SELECT service_name, server_region,
                CASE WHEN e > 10 THEN 'critical' WHEN e > 3 THEN 'warning' ELSE 'healthy' END AS error_band,
                CASE WHEN a > 99 THEN 'healthy' WHEN a > 95 THEN 'warning' ELSE 'critical' END AS availability_band
                FROM (SELECT service_name, server_region, {fig(ERR)} AS e, {fig("100 - " + ERR)} AS a
                      FROM logs GROUP BY ALL)""",
        ),
        "prj_change_label": labelled(change_label),
        "prj_change_cell": labelled(change_cell),
        "prj_regression_verdict": over(
            "logs",
            f"SELECT service_name, release_version, {VERDICT} FROM changes",
            perf=RELEASE_PERF_BY_SERVICE,
            changes=regressions("perf", "service_name"),
        ),
        "prj_seconds": over(
            "logs",
            f"SELECT endpoint, service_name, {screen('p95_latency_ms / 1000', 2)} || 's' AS p95 FROM perf",
            perf=ENDPOINT_PERF,
        ),
        "prj_display_names": over(
            "cleaned",
            """SELECT CASE service_name WHEN 'unknown-service' THEN 'Unknown Service' ELSE service_name END AS service,
               CASE endpoint WHEN 'unknown-endpoint' THEN 'Unknown Endpoint' ELSE endpoint END AS endpoint,
               CASE release_version WHEN 'unknown' THEN 'Unclassified' ELSE release_version END AS release,
               CASE server_region WHEN 'unknown' THEN 'Unclassified' ELSE server_region END AS region, requests
               FROM (SELECT service_name, endpoint, release_version, server_region, count(*) AS requests
                     FROM cleaned GROUP BY ALL)""",
        ),
        # Aggregates
        "agg_error_rate": over("logs", f"SELECT {ERR} AS error_rate_percent FROM logs"),
        "agg_percentiles": over(
            "logs",
            f"""SELECT {AVG} AS avg, {cell(p(0.5))} AS p50, {cell(p(0.95))} AS p95, {cell(p(0.99))} AS p99,
                {MAX} AS max FROM logs""",
        ),
        "agg_latency_metrics": over(
            "logs",
            f"""SELECT {AVG} AS avg_latency_ms, {cell(p(0.95))} AS p95_latency_ms, {cell(p(0.99))} AS p99_latency_ms,
                {MAX} AS max_latency_ms FROM logs""",
        ),
        "agg_kpis": over("logs", f"SELECT {kpi_columns()} FROM logs"),
        "agg_period_comparison": over("halves", change_columns("halves")),
        "agg_overview": over(
            "halves", f"SELECT * FROM (SELECT {kpi_columns()} FROM logs), ({change_columns('halves')})"
        ),
        "agg_latency_trend": over("logs", trend),
        "agg_endpoint_perf": over("logs", ENDPOINT_PERF),
        "agg_release_perf": over("logs", RELEASE_PERF),
        "agg_region_perf": over("logs", REGION_PERF),
        "agg_service_summary": over("logs", SERVICE_SUMMARY + " ORDER BY service_name"),
        "agg_service_detail": over(
            "logs",
            f"""SELECT s.*, p99_latency_ms, {json("endpoints")} AS endpoints, {json("releases")} AS releases,
                {json("regions")} AS regions, {json("latency_trend")} AS latency_trend, CAST(NULL AS VARCHAR) AS error_trend
                FROM ({SERVICE_SUMMARY}) s
                JOIN (SELECT service_name, {fig(p(0.99))} AS p99_latency_ms,
                        list_sort(list(DISTINCT endpoint)) AS endpoints,
                        list_sort(list(DISTINCT release_version)) AS releases,
                        list_sort(list(DISTINCT server_region)) AS regions FROM logs GROUP BY service_name) l
                  USING (service_name)
                JOIN (SELECT service_name, list({
                    struct("date avg_latency_ms p95_latency_ms p99_latency_ms max_latency_ms")
                } ORDER BY date) AS latency_trend FROM (
                        SELECT service_name, CAST(timestamp AS DATE) AS date, {TREND} FROM logs GROUP BY ALL)
                      GROUP BY service_name) t USING (service_name)""",
        ),
        "agg_service_endpoints": over("logs", "SELECT DISTINCT service_name, endpoint FROM logs"),
        "agg_service_breakdown": over("logs", service_tables),
        "agg_endpoint_detail": over(
            "logs",
            f"""SELECT f.* EXCLUDE (place), {fig("max_ms")} AS max_latency_ms, {fig("e4")} AS error_rate_4xx_percent,
                {fig("e5")} AS error_rate_5xx_percent
                FROM (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY service_name) AS place
                      FROM ({ENDPOINT_PERF})) f
                JOIN (SELECT endpoint, {MAX} AS max_ms, {ERR4} AS e4, {ERR5} AS e5 FROM logs GROUP BY endpoint) a
                  USING (endpoint) WHERE place = 1""",
        ),
        "agg_endpoint_service_detail": over(
            "logs",
            f"""SELECT endpoint, service_name, {ENDPOINT}, {fig(MAX)} AS max_latency_ms,
                {fig(ERR4)} AS error_rate_4xx_percent, {fig(ERR5)} AS error_rate_5xx_percent FROM logs
                GROUP BY endpoint, service_name""",
        ),
        "agg_endpoint_breakdown": over("logs", f"SELECT * EXCLUDE (status) FROM ({endpoint_tables})"),
        "agg_endpoint_trend": over(
            "logs", f"SELECT endpoint, {day} AS date, {TREND} FROM logs GROUP BY ALL"
        ),
        "agg_kpis_by_service": over(
            "logs", f"SELECT service_name, {kpi_columns('1::BIGINT')} FROM logs GROUP BY service_name"
        ),
        "agg_regions_list": over("logs", "SELECT DISTINCT server_region FROM logs ORDER BY 1"),
        "agg_overview_cleaned": over(
            "cleaned",
            f"SELECT * FROM (SELECT {kpi_columns()} FROM cleaned), ({change_columns('cleaned_halves')})",
            bounds="SELECT epoch_us(min(timestamp)) + epoch_us(max(timestamp)) AS lohi FROM cleaned",
            cleaned_halves="SELECT cleaned.*, 2 * epoch_us(timestamp) >= lohi AS is_current FROM cleaned, bounds",
        ),
        "agg_endpoint_perf_cleaned": over("cleaned", ENDPOINT_PERF.replace("FROM logs", "FROM cleaned")),
        "lg_error_rate_by_endpoint": over(
            "logs",
            """SELECT endpoint, count(*) FILTER (WHERE status_code >= 400) * 100e0 / count(*) AS error_rate
               FROM logs GROUP BY endpoint""",
        ),
        "lg_daily_latency": over(
            "logs",
            f"""SELECT {day} AS log_date, {AVG} AS avg_latency, max(response_time_ms) AS max_latency
                FROM logs GROUP BY log_date ORDER BY log_date""",
        ),
        "lg_release_perf": over(
            "logs",
            f"""SELECT release_version, {AVG} AS avg_latency, {cell(p(0.95))} AS p95_latency, {ERR} AS error_rate
                FROM logs GROUP BY release_version""",
        ),
        # Comparisons, outliers, scores
        "win_release_regressions": perf_regressions,
        "win_release_regressions_lex": perf_regressions,
        "win_release_regressions_by_service": over(
            "logs", regressions("perf", "service_name"), perf=RELEASE_PERF_BY_SERVICE
        ),
        "win_release_pair": over(
            "logs",
            """SELECT * FROM changes WHERE previous_release_version IS NOT NULL
               ORDER BY release_version DESC LIMIT 1""",
            perf=RELEASE_PERF,
            changes=regressions("perf"),
        ),
        "win_release_stability": over(
            "logs",
            f"SELECT *, {VERDICT} FROM changes WHERE previous_release_version IS NOT NULL",
            perf=RELEASE_PERF,
            changes=regressions("perf"),
        ),
        "rel_compare": over(
            "logs",
            f"""SELECT release_version, {RELEASE} FROM logs
                WHERE service_name = 'user-service' AND release_version IN ('v1.0', 'v2.0') GROUP BY release_version""",
        ),
        "win_ntile_p95": over(
            "logs",
            """SELECT endpoint, avg(response_time_ms) AS avg_latency, max(response_time_ms) AS p95_latency FROM (
               SELECT endpoint, response_time_ms,
                      ntile(20) OVER (PARTITION BY endpoint ORDER BY response_time_ms) AS bucket FROM logs)
               WHERE bucket = 20 GROUP BY endpoint""",
        ),
        "out_iqr": over(
            "logs",
            f"""SELECT logs.*, q3 + (q3 - q1) * 1.5e0 AS threshold_ms FROM logs, ({_quartiles()})
                WHERE response_time_ms < q1 - (q3 - q1) * 1.5e0 OR response_time_ms > q3 + (q3 - q1) * 1.5e0""",
        ),
        "out_p99": over(
            "logs",
            f"""SELECT logs.*, {cell("p99")} AS threshold_ms FROM logs, (SELECT {p(0.99)} AS p99 FROM logs)
                WHERE response_time_ms > p99""",
        ),
        "out_zscore": over(
            "logs",
            """SELECT logs.*, CAST(NULL AS DOUBLE) AS threshold_ms FROM logs,
               (SELECT avg(response_time_ms) AS m, stddev_samp(response_time_ms) AS s FROM logs)
               WHERE s > 0 AND abs((response_time_ms - m) / s) > 3""",
        ),
        "out_dispatch": over(
            "logs",
            f"""SELECT * EXCLUDE (p99), {cell("p99")} AS threshold_ms, 'p99' AS method, count(*) OVER () AS outlier_count
                FROM (SELECT * FROM logs WHERE service_name = 'order-service'),
                     (SELECT {p(0.99)} AS p99 FROM logs WHERE service_name = 'order-service')
                WHERE response_time_ms > p99 ORDER BY response_time_ms DESC, {LOG} LIMIT 100""",
        ),
        "lg_out_zscore_pop": over(
            "logs",
            f"""SELECT * FROM (SELECT {LOG}, {cell("(response_time_ms - m) / s", 6)} AS z_score FROM logs,
                (SELECT avg(response_time_ms) AS m, stddev_pop(response_time_ms) AS s FROM logs))
                WHERE abs(z_score) > 3""",
        ),
        "lg_out_endpoint_p95": over(
            "logs",
            f"""SELECT {LOG}, {cell("p95")} AS endpoint_p95 FROM logs
                JOIN (SELECT endpoint, {p(0.95)} AS p95 FROM logs GROUP BY endpoint) USING (endpoint)
                WHERE response_time_ms > p95""",
        ),
        "scr_reliability": over("logs", reliability.format(keys="service_name")),
        "scr_reliability_by_endpoint": over("logs", reliability.format(keys="service_name, endpoint")),
        "lg_stability_top10": over(
            "logs",
            f"""SELECT endpoint, {AVG} AS avg_latency, {ERR} AS error_rate,
                {AVG} * 0.6e0 + {ERR} * 0.4e0 AS stability_score
                FROM logs GROUP BY endpoint ORDER BY stability_score DESC, endpoint LIMIT 10""",
        ),
        # Incidents
        "inc_affected_endpoints": over(
            "logs",
            f"SELECT service_name, {json('affected_endpoints')} AS affected_endpoints FROM ({affected('logs')})",
        ),
        "inc_high_error_rate": over(
            "logs", f"SELECT * FROM ({detect('logs')}) WHERE trigger_type = 'high_error_rate'"
        ),
        "inc_high_latency": over("logs", f"SELECT * FROM ({detect('logs')}) WHERE trigger_type = 'high_latency'"),
        "inc_sudden_latency": on_incidents(
            "SELECT * FROM violations WHERE trigger_type = 'sudden_latency_increase'"
        ),
        "inc_detect": on_incidents("SELECT * FROM violations"),
        "inc_detect_overrides": over("logs", detect("logs", err=5.0, p95=600.0)),
        "inc_dedup_open": on_incidents("SELECT * FROM created"),
        "inc_already_open": on_incidents("SELECT * FROM violations SEMI JOIN blocked USING (service, trigger_type)"),
        "inc_detect_summary": on_incidents(
            """SELECT *, CASE
                 WHEN incidents_created > 0 THEN incidents_created || ' new incident' ||
                   CASE WHEN incidents_created = 1 THEN '' ELSE 's' END || ' created' ||
                   CASE WHEN incidents_already_open > 0 THEN ' · ' || incidents_already_open || ' already open' ELSE '' END
                 WHEN incidents_already_open > 0 THEN 'No new incidents — ' || incidents_already_open || ' violation' ||
                   CASE WHEN incidents_already_open = 1 THEN '' ELSE 's' END || ' already have an open incident'
                 ELSE 'No threshold violations found' END AS message
               FROM (SELECT (SELECT count(*) FROM created) AS incidents_created,
                     (SELECT count(*) FROM violations SEMI JOIN blocked USING (service, trigger_type))
                       AS incidents_already_open)"""
        ),
        "inc_list": on_incidents("SELECT * FROM all_incidents ORDER BY started_at DESC, id"),
        "inc_get": on_incidents("SELECT * FROM all_incidents ORDER BY id LIMIT 1"),
        "inc_recent5": on_incidents("SELECT * FROM all_incidents ORDER BY started_at DESC, id LIMIT 5"),
        "inc_status_update": on_incidents(
            f"""SELECT {incident_columns}, coalesce(wanted, status) AS status,
                CASE WHEN wanted = 'resolved' THEN coalesce(ended_at, TIMESTAMP '2002-01-01')
                     WHEN wanted IS NULL THEN ended_at END AS ended_at,
                CASE WHEN wanted IS NULL THEN updated_at ELSE TIMESTAMP '2002-01-01' END AS updated_at
                FROM (SELECT *, CASE WHEN status = 'resolved' THEN 'open'
                        WHEN trigger_type IN ('high_latency', 'sudden_latency_increase') THEN 'resolved' END AS wanted
                      FROM all_incidents)"""
        ),
        "inc_context": on_incidents(
            f"""SELECT id, service, trigger_type, error_rate_percent, avg_latency_ms, p95_latency_ms,
                {json("affected_endpoints")} AS affected_endpoints FROM all_incidents
                JOIN (SELECT service_name, {fig(ERR)} AS error_rate_percent, {fig(AVG)} AS avg_latency_ms,
                        {fig(p(0.95))} AS p95_latency_ms FROM logs GROUP BY service_name) k ON service = k.service_name
                JOIN ({affected("logs")}) a ON service = a.service_name"""
        ),
        # Log pages, lookups, rankings
        "log_page": over(
            "logs",
            f"""SELECT {LOG}, total FROM (SELECT *, count(*) OVER () AS total FROM logs
                WHERE service_name = 'user-service') ORDER BY timestamp DESC, {", ".join(LOG_COLUMNS[1:])}
                LIMIT 50 OFFSET 100""",
        ),
        "log_page_after": over(
            "logs",
            f"""SELECT {LOG}, CAST((place - 1) // 50 + 1 AS INT) AS page FROM (
                SELECT *, row_number() OVER (ORDER BY timestamp DESC, {log_id}) AS place FROM (SELECT DISTINCT * FROM logs))
                WHERE place <= 250""",
        ),
        "log_page_far": over(
            "logs",
            f"""SELECT *, (SELECT count(*) FROM logs) AS total FROM logs
                ORDER BY timestamp DESC, {", ".join(LOG_COLUMNS[1:])} LIMIT 25 OFFSET 12475""",
        ),
        "log_get": over("logs", f"SELECT * FROM logs ORDER BY {LOG} LIMIT 1"),
        "log_page_count": over("logs", "SELECT greatest(1, (count(*) + 24) // 25) AS page_count FROM logs"),
        "top5_services_error": over(
            "logs", f"SELECT * FROM ({SERVICE_SUMMARY}) ORDER BY error_rate_percent DESC, service_name LIMIT 5"
        ),
        "top5_slowest_endpoints": over(
            "logs", f"SELECT * FROM ({ENDPOINT_PERF}) ORDER BY p95_latency_ms DESC, endpoint, service_name LIMIT 5"
        ),
        "top10_slowest_endpoints": over(
            "logs", f"SELECT * FROM ({ENDPOINT_PERF}) ORDER BY p95_latency_ms DESC, endpoint, service_name LIMIT 10"
        ),
        # Documents and text
        "ctx_summary": over("logs", SUMMARIES),
        "ctx_summary_filtered": over(
            "logs", f"SELECT context FROM ({SUMMARIES}) WHERE service = 'user-service' AND release = 'v2.0'"
        ),
        "ctx_incident": on_incidents(INCIDENT_DOCUMENTS, service_kpis=SERVICE_KPIS),
        "ctx_service": over("logs", SERVICE_DOCUMENTS, **SERVICE_TABLES),
        "ctx_chat": over("logs", f"SELECT {CHAT} AS context"),
        "txt_prompt": on_incidents(
            f"""SELECT 'summary' AS kind, service || ' / ' || release AS subject,
                  {text(prompts.SUMMARY_LEAD)} || context AS prompt FROM ({SUMMARIES})
                UNION ALL SELECT 'incident', id, {text(prompts.INCIDENT_LEAD)} || context FROM ({INCIDENT_DOCUMENTS})
                UNION ALL SELECT 'service', service, {text(prompts.SERVICE_LEAD)} || context FROM ({SERVICE_DOCUMENTS})""",
            **SERVICE_TABLES,
        ),
        "txt_prompt_chat": over(
            "logs",
            f"""SELECT conv_id, turn, coalesce(history || chr(10), '') || {text(prompts.CHAT_LEAD)} || context ||
                {text(prompts.CHAT_QUESTION)} || text || {text(prompts.CHAT_TAIL)} AS prompt
                FROM (SELECT DISTINCT ON (conv_id) * FROM conversations WHERE role = 'user' ORDER BY conv_id, turn DESC) q
                LEFT JOIN (SELECT c.conv_id AS of_conv, string_agg(c.role || ': ' || c.text, chr(10) ORDER BY c.turn) AS history
                           FROM conversations c JOIN (SELECT conv_id, max(turn) AS asked FROM conversations
                             WHERE role = 'user' GROUP BY conv_id) l ON l.conv_id = c.conv_id AND c.turn < asked
                           GROUP BY c.conv_id) h ON of_conv = conv_id, (SELECT {CHAT} AS context)""",
        ),
        "txt_history": """SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history
            FROM conversations GROUP BY conv_id""",
        "json_response_parse": f"WITH answers AS ({ANSWERS}) {PARSED}",
        # Streams
        "st_clean": over("cleaned", "SELECT * FROM cleaned"),
        "st_daily_trend": over("logs", trend),
        "st_daily_trend_windows": over(
            "logs",
            f"""SELECT {day} AS date, count(*) AS requests, {TREND} FROM logs GROUP BY date
                HAVING max(CAST(timestamp AS DATE)) + INTERVAL 2 DAY <= (SELECT max(timestamp) FROM logs)""",
        ),
        "st_kpis_sketched": over(
            "logs",
            f"""SELECT service_name, count(*) AS total_requests, {fig(ERR)} AS error_rate_percent,
                {fig("100 - " + ERR)} AS availability_percent, {fig(AVG)} AS avg_latency_ms,
                max(response_time_ms) AS max_latency_ms, count(*) FILTER (WHERE response_time_ms > 1000) AS slow_requests,
                count(DISTINCT endpoint) AS endpoints, true AS ranks_close FROM logs GROUP BY service_name""",
        ),
        "st_kpis": over(
            "logs",
            f"""SELECT {day} AS day, service_name, {kpi_columns("1::BIGINT")} FROM logs
                GROUP BY day, service_name""",
        ),
        "st_incidents": over(
            "cleaned",
            """SELECT id, title, severity, service, started_at, CAST(NULL AS TIMESTAMP) AS ended_at, trigger_type, description,
                 started_at AS created_at, CASE WHEN acknowledged THEN started_at + INTERVAL 10 DAY ELSE started_at END AS updated_at,
                 CASE WHEN acknowledged THEN 'acknowledged' ELSE 'open' END AS status
               FROM (
                 SELECT *, trigger_type = 'high_error_rate' AND started_at = first AS acknowledged,
                   row_number() OVER (PARTITION BY service, trigger_type, started_at >= first + INTERVAL 10 DAY
                                      ORDER BY started_at) AS nth
                 FROM (SELECT *, min(started_at) OVER (PARTITION BY service, trigger_type) AS first FROM found))
               WHERE started_at = first OR (trigger_type = 'high_error_rate' AND nth = 1
                 AND started_at >= first + INTERVAL 10 DAY)""",
            found=f"""SELECT sha256(service || '|' || trigger_type || '|' || CAST(started_at AS VARCHAR)) AS id, *
                FROM ({detect_per_day("cleaned")})""",
        ),
    }
    # Reports from stored counts are those over all logs.
    for name in ("agg_overview", "agg_latency_trend", "agg_endpoint_perf", "agg_service_detail", "ctx_chat", "inc_detect"):
        sql[f"{name}_stored"] = sql[name]
    sql["agg_kpis_stored_range"] = over(
        "logs",
        f"""SELECT {kpi_columns()} FROM logs WHERE service_name = 'order-service'
            AND timestamp >= TIMESTAMP '1996-03-05' AND timestamp <= TIMESTAMP '1997-04-01 12:00:00'""",
    )
    return sql
