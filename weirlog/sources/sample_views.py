"""Request-log views over the sample tables (parquet files in one folder)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# One row per event; every 20th event is logged twice, as dirty sources do.
RAW_COLUMNS = (
    "CASE WHEN event_id % 97 = 0 THEN 'not-a-date' ELSE CAST(ts AS STRING) END AS timestamp",
    """CASE user_id % 5 WHEN 0 THEN 'auth-service' WHEN 1 THEN ' user-service ' WHEN 2 THEN 'order-service'
       WHEN 3 THEN '' END AS service_name""",
    """CASE k % 6 WHEN 0 THEN '/' || event_type WHEN 1 THEN '/' || upper(event_type)
       WHEN 2 THEN '/' || event_type || '/' WHEN 3 THEN '  /' || event_type || '// ' WHEN 4 THEN '' END AS endpoint""",
    """CASE event_id % 13 WHEN 0 THEN '400' WHEN 1 THEN '404' WHEN 2 THEN '500' WHEN 3 THEN '503' WHEN 4 THEN '999'
       WHEN 5 THEN NULL WHEN 6 THEN 'abc' WHEN 7 THEN '201' ELSE '200' END AS status_code""",
    """CASE event_id % 8 WHEN 6 THEN '-1' WHEN 7 THEN NULL
       WHEN 5 THEN CAST(CAST(floor(value * 4) AS BIGINT) + 600 AS STRING)
       ELSE CAST(CAST(floor(value * 2) AS BIGINT) + 1 AS STRING) END AS response_time_ms""",
    """CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'v1.0' WHEN 2 THEN 'v1.0' WHEN 3 THEN 'v1.1'
       WHEN 4 THEN 'v1.1' ELSE 'v2.0' END AS release_version""",
    """CASE (event_id + user_id) % 5 WHEN 0 THEN 'us-east' WHEN 1 THEN 'us-west' WHEN 2 THEN 'eu-central'
       WHEN 3 THEN 'ap-south' END AS server_region""",
)

CLEAN_COLUMNS = (
    "l_shipdate AS timestamp",
    """CASE l_suppkey % 4 WHEN 0 THEN 'auth-service' WHEN 1 THEN 'user-service' WHEN 2 THEN 'order-service'
       ELSE 'unknown-service' END AS service_name""",
    "'/api/v1/p' || CAST(l_partkey % 12 AS STRING) AS endpoint",
    """CASE WHEN (l_partkey * 7 + l_linenumber * 13 + l_orderkey) % 1000 <
                 CASE l_suppkey % 4 WHEN 0 THEN 10 WHEN 1 THEN 35 WHEN 2 THEN 120 ELSE 300 END
            THEN CASE WHEN l_linenumber % 2 = 0 THEN 404 ELSE 503 END ELSE 200 END AS status_code""",
    """CAST(floor(l_extendedprice * (CASE l_returnflag WHEN 'R' THEN 1.4e0 ELSE 1e0 END)
            * (CASE WHEN l_suppkey % 4 = 1 AND year(l_shipdate) >= 1999 THEN 2e0 ELSE 1e0 END)
            / (CASE l_suppkey % 4 WHEN 0 THEN 200e0 WHEN 1 THEN 110e0 WHEN 2 THEN 40e0 ELSE 120e0 END)) AS BIGINT) + 1
       AS response_time_ms""",
    "CASE l_returnflag WHEN 'A' THEN 'v1.0' WHEN 'N' THEN 'v1.1' ELSE 'v2.0' END AS release_version",
    "r_name AS server_region",
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def raw_logs_from_events(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "*",
        "CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k",
        "explode(sequence(1, CASE WHEN event_id % 20 = 0 THEN 2 ELSE 1 END)) AS copy",
    ).selectExpr(*RAW_COLUMNS)


def raw_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Dirty text logs, one per event, some logged twice."""
    return raw_logs_from_events(table(spark, folder, "events"))


def logs_from_items(items: DataFrame, suppliers: DataFrame, nations: DataFrame, regions: DataFrame) -> DataFrame:
    """Line items are joined to one file-backed table after the other.

    Each of these has a known size, so the planner can broadcast the small ones. A
    join of them made first would have only a pessimistic estimate, and the line items
    would be shuffled.
    """
    return (
        items.join(suppliers, items["l_suppkey"] == suppliers["s_suppkey"])
        .join(nations, suppliers["s_nationkey"] == nations["n_nationkey"])
        .join(regions, nations["n_regionkey"] == regions["r_regionkey"])
        .selectExpr(*CLEAN_COLUMNS)
    )


def logs(spark: SparkSession, folder: str) -> DataFrame:
    """Clean logs, one per line item."""
    return logs_from_items(*[table(spark, folder, t) for t in ("lineitem", "supplier", "nation", "region")])


def file_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A sample table's file as a stream source."""
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def raw_log_stream(spark: SparkSession, folder: str) -> DataFrame:
    return raw_logs_from_events(file_stream(spark, folder, "events"))


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    lookups = [table(spark, folder, t) for t in ("supplier", "nation", "region")]
    return logs_from_items(file_stream(spark, folder, "lineitem"), *lookups)
