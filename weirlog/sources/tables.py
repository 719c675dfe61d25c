"""Catalog tables: raw and clean logs, the dataset registry and incidents.

Log tables are partitioned by ``dataset_id``: a scan of one dataset reads its
partitions only, removing a dataset drops partitions, and loading one again after a
failure replaces what the failed attempt left. Clean logs are further partitioned by
month, so a date filter (see ``filter_logs``) skips whole months. Beside the clean rows lie
their counts by day, dimensions and latency value, from which reports are made without
reading rows; they are written with the rows of a dataset and go with them. Incidents are
partitioned by the day they started, so a status change rewrites the days of the
changed incidents only.
"""

from __future__ import annotations

import posixpath
import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import cleaning, incidents
from ..operators.explore import with_log_id
from ..operators.filters import filter_logs, month_of
from ..operators.joins import size_checked
from ..operators.metrics import log_counts
from ..schema import LOG_COLUMNS
from .csv_logs import content_digests, digest_of_hashes, line_hashes, read_raw_csv
from .shared import durable

# Overwriting a dataset clears all its partitions, whatever the session's own mode is.
_REPLACE_ALL = "partitionOverwriteMode 'static'"
# Parquet bloom filters: a lookup by id skips the row groups that cannot hold it.
_OPTIONS = {
    "raw_logs": _REPLACE_ALL,
    "api_logs": f"{_REPLACE_ALL}, `parquet.bloom.filter.enabled#log_id` 'true'",
    "log_counts": _REPLACE_ALL,
    "datasets": _REPLACE_ALL,
    "incidents": "partitionOverwriteMode 'dynamic'",
}

_TABLES = {
    "raw_logs": (", ".join(f"{c} STRING" for c in LOG_COLUMNS) + ", dataset_id STRING", "dataset_id"),
    "api_logs": (
        "timestamp TIMESTAMP_NTZ, service_name STRING, endpoint STRING, status_code INT, response_time_ms BIGINT, "
        "release_version STRING, server_region STRING, log_id STRING, dataset_id STRING, log_month DATE",
        "dataset_id, log_month",
    ),
    "log_counts": (
        "day DATE, service_name STRING, endpoint STRING, release_version STRING, server_region STRING, "
        "response_time_ms BIGINT, n BIGINT, n_4xx BIGINT, n_5xx BIGINT, first_at TIMESTAMP_NTZ, last_at TIMESTAMP_NTZ, "
        "dataset_id STRING, log_month DATE",
        "dataset_id, log_month",
    ),
    "datasets": (
        "name STRING, file_name STRING, row_count BIGINT, status STRING, created_at TIMESTAMP, updated_at TIMESTAMP, "
        "digest STRING, dataset_id STRING",
        "dataset_id",
    ),
    "incidents": (
        "id STRING, title STRING, severity STRING, status STRING, service STRING, started_at TIMESTAMP_NTZ, "
        "ended_at TIMESTAMP_NTZ, trigger_type STRING, description STRING, created_at TIMESTAMP_NTZ, "
        "updated_at TIMESTAMP_NTZ, started_on DATE",
        "started_on",
    ),
}


_DATASET_TABLES = ("raw_logs", "api_logs", "log_counts", "datasets")


class LogTables:
    """The tables of one database of the session's catalog."""

    def __init__(self, spark: SparkSession, database: str, location: str | None = None):
        self.spark = spark
        self.database = database
        where = f" LOCATION '{location}'" if location else ""
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{where}")
        for name, (columns, partition) in _TABLES.items():
            spark.sql(
                f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet"
                f" OPTIONS ({_OPTIONS[name]}) PARTITIONED BY ({partition})"
            )
        if "digest" not in self._table("datasets").columns:  # a registry of an earlier version
            spark.sql(f"ALTER TABLE {database}.datasets ADD COLUMNS (digest STRING)")

    def _name(self, table: str) -> str:
        return f"{self.database}.{table}"

    def _table(self, table: str) -> DataFrame:
        return self.spark.table(self._name(table))

    def _replace_dataset(self, rows: DataFrame, table: str, dataset_id: str) -> None:
        """Put rows in the place of everything that is stored under a dataset, also when there are none."""
        columns, key = self._table(table).columns, "dataset_id"
        rest = [c for c in columns if c != key]
        # A literal partition value clears all of the dataset's partitions before the new ones are added.
        months = ", log_month" if "log_month" in columns else ""
        self.spark.sql(
            f"INSERT OVERWRITE TABLE {self._name(table)} PARTITION ({key} = {_quoted(dataset_id)}{months}) SELECT * FROM {{rows}}",
            rows=rows.select(*rest),
        )

    # Logs and datasets

    def land_raw(self, raw: DataFrame, dataset_id: str) -> DataFrame:
        """Store raw rows as they came; return the stored rows."""
        self._replace_dataset(raw, "raw_logs", dataset_id)
        return self._table("raw_logs").where(F.col("dataset_id") == dataset_id).select(*LOG_COLUMNS)

    def persist_clean(
        self, cleaned: DataFrame, dataset_id: str, name: str, file_name: str, digest: str | None = None
    ) -> int:
        """Store clean rows under a dataset, then register it; return the row count.

        Rows are gathered by month and service for writing; adaptive execution splits large
        groups over several tasks and merges small ones, so a service lies in few files of a
        month. Within each file rows are sorted by service and endpoint, so that row-group
        statistics can skip most of what is left for a filter on either.
        """
        ordered = _in_order(cleaned.withColumn("dataset_id", F.lit(dataset_id)))
        self._drop_partitions("datasets", dataset_id)  # not seen while rows and counts are replaced
        self._replace_dataset(ordered, "api_logs", dataset_id)
        rows = self._recount(dataset_id)
        entry = self.spark.range(1).select(F.lit(name).alias("name"), F.lit(file_name).alias("file_name"), F.lit(digest).alias("digest"))
        entry = entry.withColumn("row_count", F.lit(rows).cast("bigint"))
        self._replace_dataset(_registered_now(entry), "datasets", dataset_id)
        return rows

    def _recount(self, dataset_id: str) -> int:
        """Replace the counts of a dataset by those of its stored rows; return how many rows these are."""
        counts = log_counts(self._stored(dataset_id), "log_month").hint("rebalance", "log_month")
        ordered = counts.sortWithinPartitions("log_month", "day", "service_name", "endpoint")
        self._replace_dataset(ordered, "log_counts", dataset_id)
        own = self._table("log_counts").where(F.col("dataset_id") == dataset_id)
        return own.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def counts(
        self,
        dataset_id: str | None = None,
        date_from: str | datetime | None = None,
        date_to: str | datetime | None = None,
        halves: bool = False,
        **equal: str | None,
    ) -> DataFrame:
        """Request counts of clean logs of one dataset, or of all registered ones, in the place of the logs themselves.

        ``equal`` are filters on service, endpoint, release and region; dates are inclusive instants, as in
        ``filter_logs``. With ``halves`` the counts are split at the middle of their range of time
        (``is_current``). Counts are kept by day, so where an instant cuts a day, and
        counts of that day lie on both sides of it, the rows of that day are counted instead.
        Everything else is read from the counts alone.
        """
        counts = filter_logs(self._registered("log_counts", dataset_id), **equal)
        rows = filter_logs(self._registered("api_logs", dataset_id), **equal)
        month = F.col("log_month")
        if date_from:
            start = _instant(date_from)
            counts = _split(counts.where(month >= month_of(start)), rows, start).where(F.col("first_at") >= start)
            rows = rows.where(F.col("timestamp") >= start)
        if date_to:
            end = _instant(date_to)
            counts = _split(counts.where(month <= month_of(end)), rows, end, inclusive=True).where(F.col("last_at") <= end)
            rows = rows.where(F.col("timestamp") <= end)
        if halves:
            first, last = F.min("first_at"), F.max("last_at")
            found = counts.agg((first + (last - first) / 2).alias("middle")).first()["middle"]
            middle = _instant(found or datetime(1970, 1, 1))
            counts = _split(counts, rows, middle).withColumn("is_current", F.col("first_at") >= middle)
        return counts

    def scan(self, dataset_id: str | None = None) -> DataFrame:
        """Clean logs of one dataset, or of all registered ones.

        A dataset is registered after its rows are stored, so rows that a failed load
        left behind are never seen.
        """
        return self._registered("api_logs", dataset_id)

    def _registered(self, table: str, dataset_id: str | None) -> DataFrame:
        rows = self._table(table)
        if dataset_id:
            rows = rows.where(F.col("dataset_id") == dataset_id)
        columns = rows.columns
        return rows.join(self._table("datasets").select("dataset_id"), "dataset_id", "left_semi").select(*columns)

    def _stored(self, dataset_id: str) -> DataFrame:
        return self._table("api_logs").where(F.col("dataset_id") == dataset_id)

    def ingest(
        self,
        path: str,
        name: str | None = None,
        force: bool = True,
        multi_line: bool = False,
        timestamp_format: str | None = None,
    ) -> DataFrame:
        """Read, check, clean and store a CSV; return one row with its counters.

        Without ``force`` a file name that is registered already is not loaded again:
        the newest dataset of that name is returned. Unless a timestamp format is named, the first
        value decides (see ``cleaning.timestamp_formats``).
        """
        file_name = posixpath.basename(path.rstrip("/"))
        if not force:
            known = self.find_dataset(file_name).first()
            if known is not None:
                return self._ingested(known["dataset_id"], known["row_count"], None)
        dataset_id = str(uuid.uuid4())
        raw = self.land_raw(read_raw_csv(self.spark, path, multi_line), dataset_id)
        timestamp_format = timestamp_format or cleaning.infer_timestamp_format(raw)
        hashes, digest = line_hashes(), digest_of_hashes().alias("digest")
        counts = durable(cleaning.drop_counts(raw.withColumns(hashes), timestamp_format, [digest], [*hashes]))
        cleaned = cleaning.clean(raw, timestamp_format)
        rows = self.persist_clean(cleaned, dataset_id, name or file_name, file_name, counts.first()["digest"])
        return self._ingested(dataset_id, rows, counts)

    def ingest_folder(self, path: str, multi_line: bool = False, timestamp_format: str | None = None) -> DataFrame:
        """Load every CSV file of a folder that is not there yet, all in one go; one row per file.

        Returns file_name, dataset_id, already_loaded and clean_rows. A file is known by the content of its rows, in
        any order, whatever it is called: files that a registered dataset was made of are not loaded again, and of files with
        the same content the first by name is. Each file becomes a dataset whose id follows from its content, so
        a load that failed can be repeated. All files have one timestamp format, which the first value of the
        new ones decides unless it is named. A file without rows gives nothing.
        """
        raw = read_raw_csv(self.spark, path, multi_line, file_name="file_name")
        registered = self._table("datasets").where("digest IS NOT NULL").groupBy("digest")
        registered = registered.agg(F.max_by("dataset_id", F.struct("created_at", "dataset_id")).alias("known_id"))
        nth = F.row_number().over(Window.partitionBy("digest").orderBy("file_name"))
        files = content_digests(raw, "file_name").join(registered, "digest", "left").withColumn("nth", nth)
        new_id = F.regexp_replace(F.substring("digest", 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
        loaded = F.col("known_id").isNull() & (F.col("nth") == 1)
        files = durable(files.select("file_name", "digest", F.coalesce("known_id", new_id).alias("dataset_id"), loaded.alias("is_new")))
        new = files.where("is_new")
        ids = [r.dataset_id for r in new.select("dataset_id").collect()]  # one per file
        if ids:
            self._load(raw.join(size_checked(new.select("file_name", "dataset_id")), "file_name"), new, ids, timestamp_format)
        sizes = self._table("datasets").select("dataset_id", F.col("row_count").alias("clean_rows"))
        return files.join(sizes, "dataset_id").select("file_name", "dataset_id", (~F.col("is_new")).alias("already_loaded"), "clean_rows")

    def _load(self, raw: DataFrame, files: DataFrame, ids: list[str], timestamp_format: str | None) -> None:
        """Land, clean, count and register the rows of several datasets, each step as one job."""
        for table in _DATASET_TABLES:
            for dataset_id in ids:
                self._drop_partitions(table, dataset_id)  # what a failed load left
        self._append(raw, "raw_logs")
        landed = self._table("raw_logs").where(F.col("dataset_id").isin(ids))
        timestamp_format = timestamp_format or cleaning.infer_timestamp_format(landed)
        self._append(_in_order(cleaning.clean(landed, timestamp_format, "dataset_id")), "api_logs")
        stored = self._table("api_logs").where(F.col("dataset_id").isin(ids))
        counts = log_counts(stored, "dataset_id", "log_month").hint("rebalance", "dataset_id", "log_month")
        self._append(counts.sortWithinPartitions("dataset_id", "log_month", "day", "service_name", "endpoint"), "log_counts")
        own = self._table("log_counts").where(F.col("dataset_id").isin(ids))
        sizes = own.groupBy("dataset_id").agg(F.sum("n").alias("row_count"))
        entries = files.join(sizes, "dataset_id", "left").withColumn("row_count", F.coalesce("row_count", F.lit(0)))
        self._append(_registered_now(entries.withColumn("name", F.col("file_name"))), "datasets")

    def _append(self, rows: DataFrame, table: str) -> None:
        rows.select(*self._table(table).columns).write.mode("append").insertInto(self._name(table))

    def _ingested(self, dataset_id: str, rows: int, counts: DataFrame | None) -> DataFrame:
        clean_rows = F.lit(rows).cast("bigint")
        already_loaded = counts is None
        if already_loaded:
            unknown = F.lit(None).cast("bigint")
            names = ("raw_rows", "dropped_invalid_status", "dropped_invalid_latency", "usable_rows")
            counts = self.spark.range(1).select(*[unknown.alias(n) for n in names])
        return counts.select(
            F.lit(dataset_id).alias("dataset_id"),
            F.lit(already_loaded).alias("already_loaded"),
            "raw_rows",
            clean_rows.alias("clean_rows"),
            "dropped_invalid_status",
            "dropped_invalid_latency",
            (F.col("usable_rows") - clean_rows).alias("duplicates_removed"),
        )

    def find_dataset(self, file_name: str) -> DataFrame:
        return newest_dataset(self._table("datasets").where(F.col("file_name") == file_name))

    def list_datasets(self) -> DataFrame:
        return list_datasets(self._table("datasets"))

    def delete_dataset(self, dataset_id: str) -> None:
        """Drop the partitions of one dataset everywhere."""
        if self._table("datasets").where(F.col("dataset_id") == dataset_id).isEmpty():
            raise LookupError(f"dataset {dataset_id} not found")
        for table in reversed(_DATASET_TABLES):  # the registry first: what is half removed is not seen
            self._drop_partitions(table, dataset_id)

    def _drop_partitions(self, table: str, dataset_id: str) -> None:
        """Drop all partitions of a dataset in one statement (a catalog wants full keys)."""
        name, dataset = self._name(table), {"id": dataset_id}
        listed = self.spark.sql(f"SHOW PARTITIONS {name} PARTITION (dataset_id = :id)", dataset)
        months = [row.partition.partition("/log_month=")[2] for row in listed.collect()]
        keys = [f"PARTITION (dataset_id = :id{f', log_month = DATE {m!r}' if m else ''})" for m in months]
        if keys:
            self.spark.sql(f"ALTER TABLE {name} DROP IF EXISTS {', '.join(keys)}", dataset)

    def reset(self) -> DataFrame:
        """Empty all log tables; return how much was there."""
        logs, datasets = self._table("api_logs").count(), self._table("datasets").count()
        for table in reversed(_DATASET_TABLES):
            self.spark.sql(f"TRUNCATE TABLE {self._name(table)}")
        return self.spark.range(1).select(
            F.lit(logs).cast("bigint").alias("logs_deleted"), F.lit(datasets).cast("bigint").alias("datasets_deleted")
        )

    # Incidents

    def incidents(self) -> DataFrame:
        return self._table("incidents")

    def record(self, violations: DataFrame, detected_at: Column) -> DataFrame:
        """Append violations that have no open incident; return the counts and message."""
        violations = durable(violations)
        existing = self.incidents()
        counts = incidents.detection_counts(violations, existing).collect()
        new = incidents.as_incidents(incidents.newly_violated(violations, existing), detected_at)
        target = self.incidents().columns
        dated = new.withColumn("started_on", F.to_date("started_at"))
        dated.select(*target).write.mode("append").insertInto(self._name("incidents"))
        return self.spark.createDataFrame(
            counts, "incidents_created bigint, incidents_already_open bigint, message string"
        )

    def update_incidents(self, changes: DataFrame) -> None:
        """Apply status changes and rewrite only the days that hold a changed incident; an unknown id is an error."""
        table, changes = self.incidents(), durable(changes)
        incidents.require_known(table, changes)
        days = table.join(changes.select("id"), "id", "left_semi").select("started_on").distinct()
        touched = table.join(days, "started_on", "left_semi")
        updated = incidents.update_status(touched, changes).withColumn("started_on", F.to_date("started_at"))
        target = table.columns
        updated.select(*target).write.mode("overwrite").insertInto(self._name("incidents"))


def _in_order(cleaned: DataFrame) -> DataFrame:
    """Clean rows of datasets with their ids and months, as they are stored."""
    monthly = with_log_id(cleaned).withColumn("log_month", month_of(F.col("timestamp")))
    gathered = monthly.hint("rebalance", "dataset_id", "log_month", "service_name")
    return gathered.sortWithinPartitions("dataset_id", "log_month", "service_name", "endpoint", "timestamp")


def _registered_now(entries: DataFrame) -> DataFrame:
    now = F.current_timestamp()
    return entries.withColumns({"status": F.lit("cleaned"), "created_at": now, "updated_at": now})


def _instant(at: str | datetime) -> Column:
    """Wall-clock time, whatever the zone of the session."""
    return F.lit(str(at)).cast("timestamp_ntz")


def _split(counts: DataFrame, rows: DataFrame, at: Column, inclusive: bool = False) -> DataFrame:
    """Counts none of which lies on both sides of an instant, which itself is on the later side (``inclusive``: the earlier).

    If some do, the rows of that day, and of no other, are counted instead of its counts.
    """
    own_day = (F.col("log_month") == month_of(at)) & (F.col("day") == at.cast("date"))
    before = F.col("first_at") <= at if inclusive else F.col("first_at") < at
    behind = F.col("last_at") > at if inclusive else F.col("last_at") >= at
    if counts.where(own_day & before & behind).isEmpty():
        return counts
    ts, start = F.col("timestamp"), at.cast("date").cast("timestamp_ntz")
    of_day = rows.where(F.col("log_month") == month_of(at)).where((ts >= start) & (ts < start + F.expr("INTERVAL 1 DAY")))
    earlier = ts <= at if inclusive else ts < at
    counted = log_counts(of_day.withColumn("earlier", earlier), "dataset_id", "log_month", "earlier").drop("earlier")
    return counts.where(~own_day).unionByName(counted)


def _quoted(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def list_datasets(registry: DataFrame) -> DataFrame:
    """Registered datasets, newest first."""
    return registry.select("dataset_id", "name", "file_name", "row_count", "status", "created_at").orderBy(
        F.col("created_at").desc(), "dataset_id"
    )


def newest_dataset(registry: DataFrame) -> DataFrame:
    return registry.orderBy(F.col("created_at").desc(), "dataset_id").limit(1)
