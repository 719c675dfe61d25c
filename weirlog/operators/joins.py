"""Joining a large log to a per-group table of unknown size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import durable

BROADCAST_LIMIT_BYTES = 32 * 1024 * 1024


def size_checked(table: DataFrame, limit_bytes: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """``table``, marked for broadcast only if its measured size is within the limit.

    The table is written to the shared folder first, so measuring it does not compute
    it twice. Above the limit it is returned unmarked: the join is then a shuffled
    one, and adaptive execution splits partitions of keys that hold many rows.
    """
    table = durable(table)
    text = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in table.schema if f.dataType.typeName() == "string"]
    row_bytes = F.lit(16 * len(table.columns))
    for length in text:
        row_bytes = row_bytes + length
    size = table.agg(F.coalesce(F.sum(row_bytes.cast("bigint")), F.lit(0))).first()[0]
    return F.broadcast(table) if size <= limit_bytes else table
