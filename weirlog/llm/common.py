"""Reading tables and keeping intermediate results."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import fresh_path

#: Bytes of white space that separate words: blank, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written table.

    Cuts the lineage: lost executors cost no recomputation beyond this point, and a
    result that is used twice is computed once.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


_libc = ctypes.CDLL(None)
_caches: dict[str, Callable[[], None]] = {}


def register_cache(owner: str, clear: Callable[[], None]) -> None:
    """Name what a module keeps in a worker process between tasks."""
    _caches[owner] = clear


def claim_worker(owner: str) -> None:
    """Drop what other modules keep in this worker: one worker runs the tasks of many stages, one after the other.

    What is free is given back to the system, as the workers of an executor share its memory with the JVM.
    """
    for name, clear in _caches.items():
        if name != owner:
            clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)
