"""Log pages, single-row lookups and short rankings."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import LOG_COLUMNS
from ..sources.shared import durable

PAGE_SIZE = 25
SEEK_FROM_ROW = 10_000


def with_log_id(logs: DataFrame, dataset_id: str | None = None) -> DataFrame:
    """Add a 128-bit id made from the content, so that it needs no global numbering.

    A field is preceded by its length, so that no two contents give one text; a null field
    has no length.
    """
    dataset = F.col("dataset_id") if "dataset_id" in logs.columns else F.lit(dataset_id or "")
    fields = [c.cast("string") for c in (dataset, *(F.col(c) for c in LOG_COLUMNS))]
    parts = [F.coalesce(F.concat(F.length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in fields]
    return logs.withColumn("log_id", F.md5(F.concat(*parts).cast("binary")))


def _newest_first(logs: DataFrame) -> list[Column]:
    rest = [c for c in logs.columns if c != "timestamp"]
    tie_break = ["log_id"] if "log_id" in rest else rest
    return [F.col("timestamp").desc(), *[F.col(c) for c in tie_break]]


# Spans that a page is looked up in, from coarse to fine, in microseconds.
_SPANS = (86_400_000_000, 60_000_000, 1_000, 1)


def _micros() -> Column:
    """Wall-clock microseconds since 1970, independent of the session's zone."""
    ts = F.col("timestamp")
    minutes = (F.unix_date(F.to_date(ts)).cast("bigint") * 24 + F.hour(ts)) * 60 + F.minute(ts)
    return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")


def _instant(micros: int) -> Column:
    at = datetime(1970, 1, 1) + timedelta(microseconds=micros)
    return F.expr(f"TIMESTAMP_NTZ '{at.isoformat(sep=' ')}'")


def _on_page(rows: DataFrame, bucket: Column, skip: int, limit: int, newest_first: bool = True) -> tuple:
    """The first and the last bucket that a page lies in, and how many rows lie before them in page order.

    There are at most some 86,400 buckets of a level, whatever the number of rows.
    """
    order = F.col("bucket").desc() if newest_first else F.col("bucket").asc()
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    touched = counts.where((F.col("before") < skip + limit) & (F.col("before") + F.col("n") > skip))
    return tuple(touched.agg(F.min("bucket"), F.max("bucket"), F.min("before")).first())


def _seek(rows: DataFrame, skip: int, limit: int) -> tuple[DataFrame, int]:
    """Rows of the span of time that a page lies in, and what is left to skip.

    Each level counts rows per span within the span found before. What was found is a plain
    bound on the timestamp on both sides, so that every further level and the page itself
    read only the row groups that can hold it. Rows of one instant are told apart by their ids.
    """
    for span in _SPANS:
        if skip < SEEK_FROM_ROW:
            return rows, skip
        first, last, before = _on_page(rows, F.floor(_micros() / span).cast("bigint"), skip, limit)
        if first is None:
            return rows.where(F.lit(False)), 0
        ts = F.col("timestamp")
        rows, skip = rows.where((ts >= _instant(first * span)) & (ts < _instant((last + 1) * span))), skip - before
    if skip >= SEEK_FROM_ROW and first == last and "log_id" in rows.columns:
        start = F.substring("log_id", 1, 4)
        first, last, before = _on_page(rows, start, skip, limit, newest_first=False)
        rows, skip = rows.where(start.between(first, last)), skip - before
    return rows, skip


def _months_of_page(logs: DataFrame, skip: int, limit: int) -> tuple[DataFrame, int]:
    """Rows of the months that a page lies in, and what is left to skip.

    Counting per partition reads no more columns than the filters need; the full rows
    are then read from one or two months instead of the whole table.
    """
    first, last, before = _on_page(logs, F.col("log_month"), skip, limit)
    if first is None:
        return logs.where(F.lit(False)), 0
    return logs.where(F.col("log_month").between(F.lit(first), F.lit(last))), skip - before


def log_page(logs: DataFrame, page: int = 1, limit: int = 50) -> DataFrame:
    """One page of (already filtered) logs, newest first, with the total number of rows.

    On a table partitioned by month only the months of the page are read. Early pages
    are then a top-k. A far page would make every task keep all rows before it, so its
    start is looked up from counts first.
    """
    if page < 1 or not 1 <= limit <= 500:
        raise ValueError("page starts at 1 and limit is 1 to 500")
    total = logs.agg(F.count(F.lit(1)).alias("total")).scalar()
    rows, skip = logs, (page - 1) * limit
    if "log_month" in logs.columns:
        rows, skip = _months_of_page(rows, skip, limit)
    rows, skip = _seek(rows, skip, limit)
    return rows.orderBy(*_newest_first(logs)).offset(skip).limit(limit).withColumn("total", total)


def log_page_after(logs: DataFrame, timestamp: datetime, log_id: str, limit: int = 50) -> DataFrame:
    """The page that follows a known last row: a filter instead of an offset."""
    ts = F.lit(str(timestamp)).cast("timestamp_ntz")  # as text: a literal instant would depend on zones
    later = (F.col("timestamp") < ts) | ((F.col("timestamp") == ts) & (F.col("log_id") > log_id))
    return logs.where(later).orderBy(*_newest_first(logs)).limit(limit)


def next_page(logs: DataFrame, page: DataFrame | None, limit: int = 50) -> DataFrame:
    """The page behind a page that was given out (None: the first), by the time and id of its last row.

    The page is kept, so walking on does not find it again. Behind the last page there is an empty one.
    """
    last = page.orderBy(F.col("timestamp").asc(), F.col("log_id").desc()).first() if page is not None else None
    if page is not None and last is None:
        return page
    behind = log_page_after(logs, last["timestamp"], last["log_id"], limit) if last else logs.orderBy(*_newest_first(logs)).limit(limit)
    return durable(behind)


def log_get(logs: DataFrame, log_id: str | Column) -> DataFrame:
    return logs.where(F.col("log_id") == log_id)


def page_count(logs: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    pages = F.ceil(F.count(F.lit(1)) / F.lit(size))
    return logs.agg(F.greatest(F.lit(1).cast("bigint"), pages.cast("bigint")).alias("page_count"))


def top_services_by_error(summary: DataFrame, rows: int = 5) -> DataFrame:
    return summary.orderBy(F.col("error_rate_percent").desc(), "service_name").limit(rows)


def slowest_endpoints(endpoints: DataFrame, rows: int = 5) -> DataFrame:
    return endpoints.orderBy(F.col("p95_latency_ms").desc(), "endpoint", "service_name").limit(rows)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """The frame itself, or an error when nothing was found."""
    if df.isEmpty():
        raise LookupError(f"{what} not found")
    return df
