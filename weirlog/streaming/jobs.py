"""Streaming jobs over raw or clean request logs.

A batch writes what it adds under its own number (see ``runs``), so a batch that is run again replaces
itself, and a reader puts the batches together. Rows count however late they come, and a
result follows from the rows alone, not from how files fell into batches.

Copies are found in two ways. ``clean_stream`` keeps the ids of rows that arrived lately as state in
RocksDB, behind a watermark on the time of arrival, which no row can be late for. A row whose own
time is near its arrival cannot have come before what this state remembers. Only rows that are
old when they arrive (or lie in the future) are compared with the stored rows of their months.

Metric streams keep request counts per (day or window, keys, latency value), from which
exact percentiles are made when the table is read. Incident streams also keep the violations of
each window, judged again only for windows that a batch touched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..functions.numbers import round_table
from ..functions.times import wall_clock_micros
from ..operators import cleaning, incidents
from ..operators.explore import with_log_id
from ..operators.filters import month_of
from ..operators.joins import size_checked
from ..operators.metrics import LATENCY, kpis_of_cells, latency_cells, summarize
from ..operators.sketches import merge_sketches, request_sketches
from ..schema import CLEAN_SCHEMA, LOG_COLUMNS, RAW_SCHEMA
from ..sources.csv_logs import NULL_TOKENS
from .runs import FAN_IN, Runs, latest, summed

#: Length of the windows that incidents are detected in.
WINDOW = "1 hour"
#: Hours by which the time of a row may lie before and after its arrival (both UTC), for its copies to be found in state.
BEHIND_HOURS, AHEAD_HOURS = 24, 24
_CELL_COUNTS = ("n", "n_4xx", "n_5xx")
Batch = Callable[[DataFrame, int], None]


def raw_csv_stream(spark: SparkSession, folder: str) -> DataFrame:
    """CSV files as they arrive in a folder."""
    rows = spark.readStream.schema(RAW_SCHEMA).options(header=True, escape='"').csv(folder)
    return rows.select(*[F.when(~F.col(c).isin(*NULL_TOKENS), F.col(c)).alias(c) for c in LOG_COLUMNS])


def for_each_batch(stream: DataFrame, action: Batch, checkpoint: str) -> DataStreamWriter:
    return stream.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint)


def append_to(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Parquet sink, exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)


def run_available(writer: DataStreamWriter) -> None:
    """Process everything that is there now and stop."""
    writer.trigger(availableNow=True).start().awaitTermination()


# Counts


def cells_of_days(logs: DataFrame, *keys: str) -> DataFrame:
    """Request counts per day, key and latency value."""
    return latency_cells(logs.withColumn("day", F.to_date("timestamp")), "day", *keys)


def _cell_runs(path: str, schema: T.StructType, fan_in: int = FAN_IN) -> Runs:
    return Runs(path, schema, combine=summed(*_CELL_COUNTS), fan_in=fan_in)


def add_cells_to(path: str, cells_of: Callable[[DataFrame], DataFrame], merge_every: int = FAN_IN) -> Batch:
    """Write each batch's own counts under its number; counts of finished batches are added up now and then."""

    def write(batch: DataFrame, batch_id: int) -> None:
        cells = cells_of(batch)
        _cell_runs(path, cells.schema, merge_every).add(cells, batch_id)

    return write


def current_cells(spark: SparkSession, path: str) -> DataFrame:
    """The sum of all counts that batches added."""
    folders = Runs(path, T.StructType()).folders(spark)
    if not folders:
        raise LookupError(f"no counts below {path}")
    schema = spark.read.option("basePath", path).parquet(*folders).drop("run").schema
    return summed(*_CELL_COUNTS)(_cell_runs(path, schema).read(spark))


def daily_trend_of(cells: DataFrame) -> DataFrame:
    """Daily avg, p95, p99 and max."""
    return summarize(cells, "day").select(
        F.col("day").alias("date"),
        round_table(F.col("avg_ms")).alias("avg_latency_ms"),
        round_table(F.col("p95_ms")).alias("p95_latency_ms"),
        round_table(F.col("p99_ms")).alias("p99_latency_ms"),
        round_table(F.col("max_ms")).alias("max_latency_ms"),
    )


def daily_kpis_of(cells: DataFrame) -> DataFrame:
    """KPI bundle per day and service."""
    return kpis_of_cells(cells, "day", "service_name")


# Clean rows

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STORED_ROWS = T.StructType(
    [*CLEAN_SCHEMA.fields, T.StructField("log_id", T.StringType()), T.StructField("log_month", T.DateType())]
)
_EARLY_IDS = T.StructType([T.StructField("log_id", T.StringType()), T.StructField("log_month", T.DateType())])


def clean_stream(raw: DataFrame, behind_hours: int = BEHIND_HOURS, ahead_hours: int = AHEAD_HOURS) -> DataFrame:
    """Clean rows of a raw stream with log_id, log_month, and came: near, old or early.

    Of copies that arrive within behind_hours + ahead_hours only the first comes through: their ids are
    kept that long as state in RocksDB. came tells how a row's own time (UTC) lies to its arrival.
    A near row is at most behind_hours old and at most ahead_hours early, so a copy of it that came before
    and was not early is still in the state.
    """
    raw.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    rows = with_log_id(cleaning.usable(raw)).withColumn("log_month", month_of(F.col("timestamp")))
    rows = rows.withColumn("arrived", F.current_timestamp()).withColumn("log_key", F.unhex("log_id"))
    watermarked = rows.withWatermark("arrived", f"{behind_hours + ahead_hours} hours")
    first = watermarked.dropDuplicatesWithinWatermark(["log_key"])
    return first.select(*_STORED_ROWS.names, _came(F.col("arrived"), behind_hours, ahead_hours).alias("came"))


def _came(arrived: Column, behind_hours: int, ahead_hours: int) -> Column:
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), arrived.cast("timestamp_ntz"))
    ts = F.col("timestamp")
    old = ts < utc - F.expr(f"INTERVAL {behind_hours} HOURS")
    return F.when(old, "old").when(ts > utc + F.expr(f"INTERVAL {ahead_hours} HOURS"), "early").otherwise("near")


def _row_runs(path: str, fan_in: int = FAN_IN) -> Runs:
    return Runs(path, _STORED_ROWS, partition_by="log_month", fan_in=fan_in)


def _early_runs(path: str, fan_in: int = FAN_IN) -> Runs:
    return Runs(f"{path}/early", _EARLY_IDS, fan_in=fan_in)


def _stored_ids(runs: Runs, spark: SparkSession, months: list, before: int) -> DataFrame:
    """Ids of stored rows of some months: what old rows are compared with."""
    return runs.read(spark, before).where(F.col("log_month").isin(months)).select("log_id")


def add_clean_rows_to(path: str, merge_every: int = FAN_IN) -> Batch:
    """Write the rows of each batch that no earlier batch has, by month.

    A batch of ``clean_stream`` has had its state looked at: its near rows are new, and only old and early ones
    are compared by id with the stored rows of their months. Near rows are compared with the ids of early
    rows, of which there are hardly any. A batch of raw rows is cleaned first and compared as a whole.
    """
    runs, early = _row_runs(path, merge_every), _early_runs(path, merge_every)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if "came" not in batch.columns:
            rows = with_log_id(cleaning.clean(batch)).withColumn("log_month", month_of(F.col("timestamp")))
            batch = rows.withColumn("came", F.lit("old"))
        batch = batch.persist()  # only saves reading the batch twice; lost parts are made again
        try:
            far = batch.where("came <> 'near'")
            months = [r.log_month for r in far.select("log_month").distinct().collect()]
            rows = batch
            if months:
                known = _stored_ids(runs, spark, months, batch_id).withColumn("of", F.lit("far"))
                if early.folders(spark, batch_id):
                    known = known.unionByName(early.read(spark, batch_id).select("log_id", F.lit("near").alias("of")))
                of = F.when(F.col("came") == "near", "near").otherwise("far")
                rows = batch.withColumn("of", of).join(known, ["log_id", "of"], "left_anti")
            elif early.folders(spark, batch_id):
                rows = batch.join(early.read(spark, batch_id).select("log_id"), "log_id", "left_anti")
            ahead = far.where("came = 'early'").select("log_id", "log_month")
            if not ahead.isEmpty() or early.folders(spark, batch_id):
                early.add(ahead, batch_id)
            runs.add(rows, batch_id)
        finally:
            batch.unpersist()

    return write


def clean_rows(spark: SparkSession, path: str) -> DataFrame:
    """All clean rows that ``add_clean_rows_to`` wrote."""
    runs = _row_runs(path)
    if not runs.folders(spark):
        raise LookupError(f"no rows below {path}")
    return runs.read(spark).select(*LOG_COLUMNS)


# Incidents

_WINDOW_CELLS = T.StructType(
    [
        T.StructField("window_start", T.TimestampNTZType()),
        T.StructField("service_name", T.StringType()),
        T.StructField("endpoint", T.StringType()),
        T.StructField(LATENCY, T.LongType()),
        *(T.StructField(c, T.LongType()) for c in _CELL_COUNTS),
        T.StructField("log_month", T.DateType()),
    ]
)
_VIOLATIONS = T.StructType(
    [
        T.StructField("window_start", T.TimestampNTZType()),
        *(T.StructField(c, T.StringType()) for c in ("title", "severity", "service", "trigger_type", "description")),
        T.StructField("version", T.LongType()),
        T.StructField("log_month", T.DateType()),
    ]
)


def cells_of_windows(logs: DataFrame, length: str = WINDOW) -> DataFrame:
    """Request counts per window of event time, service, endpoint and latency value."""
    start = F.window("timestamp", length)["start"].cast("timestamp_ntz")
    return latency_cells(logs.withColumn("window_start", start), "window_start", "service_name", "endpoint")


def _window_runs(path: str, fan_in: int) -> tuple[Runs, Runs]:
    """Counts of windows, and the violations of each window, of which the last judgement counts."""
    cells = Runs(f"{path}/cells", _WINDOW_CELLS, "log_month", summed(*_CELL_COUNTS), fan_in)
    return cells, Runs(f"{path}/violations", _VIOLATIONS, "log_month", latest("window_start", "version"), fan_in)


def add_window_cells_to(path: str, length: str = WINDOW, merge_every: int = FAN_IN) -> Batch:
    """Keep the new rows of each batch, add their counts per window, and judge the windows that got some.

    Takes batches of ``clean_stream`` or of raw rows. What is read is the batch's windows in the counts of their
    months: the cost of a batch follows from its rows and not from how much came before.
    """
    add_rows = add_clean_rows_to(f"{path}/rows", merge_every)
    rows = _row_runs(f"{path}/rows", merge_every)
    cells, violations = _window_runs(path, merge_every)
    month = month_of(F.col("window_start"))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        add_rows(batch, batch_id)
        own = cells_of_windows(rows.batch(spark, batch_id).select(*LOG_COLUMNS), length)
        cells.add(own.withColumn("log_month", month), batch_id)
        windows = size_checked(cells.batch(spark, batch_id).select("window_start", "log_month").distinct())
        months = [r.log_month for r in windows.select("log_month").distinct().collect()]
        touched = cells.read(spark, batch_id + 1).where(F.col("log_month").isin(months))
        touched = touched.join(windows.select("window_start"), "window_start", "left_semi").drop("log_month")
        whole = summed(*_CELL_COUNTS)(touched).withColumn("is_current", F.lit(True))
        found = incidents.violations_of_cells(whole, False, by=("window_start",))
        # A window without violations has a row that says so, which takes the place of earlier ones.
        judged = windows.select("window_start").join(found, "window_start", "left")
        judged = judged.withColumns({"version": F.lit(batch_id).cast("bigint"), "log_month": month})
        violations.add(judged, batch_id)

    return write


def window_violations(spark: SparkSession, path: str) -> DataFrame:
    """Violated rules of all windows, each judged by all its rows so far."""
    _, violations = _window_runs(path, FAN_IN)
    rows = latest("window_start", "version")(violations.read(spark))
    return rows.where("service IS NOT NULL").drop("version", "log_month")


def window_incidents(spark: SparkSession, path: str, changes: DataFrame) -> DataFrame:
    """Incidents by the violations of all windows and the status changes (id, status, changed_at) made so far.

    Only violations are read, no counts. A window is judged by all its rows, so late ones change its violations.
    """
    return incidents.incidents_of_windows(window_violations(spark, path), changes)


# Windows behind a watermark


def daily_trend_stream(logs: DataFrame, delay: str = "1 day") -> DataFrame:
    """Daily requests, avg, p95, p99 and max as an event-time aggregate, for append mode.

    A day is given out once, when the watermark (the latest event time less the delay) has passed its end, and its state
    is dropped then. The state of a day is its distinct latency values with counts. Rows of days that are
    given out already count no more here: ``late_requests`` says how many they are.
    """
    instant = F.timestamp_micros(wall_clock_micros(F.col("timestamp")))  # watermarks want an instant: the wall clock as UTC
    days = logs.withColumn("event_time", instant).withWatermark("event_time", delay)
    ms = F.col(LATENCY)
    sums = days.groupBy(F.window("event_time", "1 day").alias("day")).agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum(ms).alias("sum_ms"),
        F.percentile(ms, [0.95, 0.99]).alias("pct_ms"),
        F.max(ms).cast("double").alias("max_ms"),
    )
    return sums.select(
        F.date_from_unix_date((F.unix_seconds(F.col("day.start")) / 86_400).cast("int")).alias("date"),
        "requests",
        round_table(F.col("sum_ms") / F.col("requests")).alias("avg_latency_ms"),
        round_table(F.col("pct_ms")[0]).alias("p95_latency_ms"),
        round_table(F.col("pct_ms")[1]).alias("p99_latency_ms"),
        round_table(F.col("max_ms")).alias("max_latency_ms"),
    )


def late_requests(trend: DataFrame, cells: DataFrame) -> DataFrame:
    """date and late: requests that came after their day was given out.

    ``cells`` are the counts per day that ``add_cells_to`` keeps of the same stream, which
    take rows however late they come.
    """
    counted = cells.groupBy(F.col("day").alias("date")).agg(F.sum("n").alias("counted"))
    late = trend.select("date", "requests").join(counted, "date").withColumn("late", F.col("counted") - F.col("requests"))
    return late.where("late > 0").select("date", "late")


# Sketches


def _sketch_runs(path: str, schema: T.StructType, keys: tuple[str, ...], fan_in: int = FAN_IN) -> Runs:
    return Runs(path, schema, combine=lambda rows: merge_sketches(rows, *keys), fan_in=fan_in)


def add_sketches_to(path: str, *keys: str, merge_every: int = FAN_IN) -> Batch:
    """Write each batch's sketches per day and key; those of finished batches are merged now and then."""

    def write(batch: DataFrame, batch_id: int) -> None:
        days = batch.withColumn("day", F.to_date("timestamp"))
        sketches = request_sketches(days, "day", *keys)
        _sketch_runs(path, sketches.schema, ("day", *keys), merge_every).add(sketches, batch_id)

    return write


def current_sketches(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """Sketches per day and key of all that batches added."""
    folders = Runs(path, T.StructType()).folders(spark)
    if not folders:
        raise LookupError(f"no sketches below {path}")
    schema = spark.read.option("basePath", path).parquet(*folders).drop("run").schema
    return merge_sketches(_sketch_runs(path, schema, ("day", *keys)).read(spark), "day", *keys)
