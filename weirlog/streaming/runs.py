"""What the batches of a stream wrote, in a bounded number of folders.

Every batch writes a folder of its own; a batch that is run again replaces it. Sixteen folders of one
level are merged into one of the next, so n batches lie in some 16 * log16(n) folders, and
what a batch wrote is written again log16(n) times in all: the cost of a batch does not grow with what
is there already. Folders that a merge has read stay until the next merge of their level, so that
readers and a repeated batch find what they need.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders of one level that are merged into one of the next.
FAN_IN = 16


class Runs:
    """Folders ``run=b<level>_<number>`` below a path; a run of level k ends with batch ``number`` and covers fan_in ** k batches.

    ``combine`` turns the rows of several batches into those that count (sums, latest
    versions); without it all rows do. ``partition_by`` is a column by which rows are stored and can be
    read in part. ``schema`` is that of the rows.
    """

    def __init__(
        self,
        path: str,
        schema: T.StructType,
        partition_by: str | None = None,
        combine: Callable[[DataFrame], DataFrame] | None = None,
        fan_in: int = FAN_IN,
    ):
        self.path, self.schema, self.partition_by, self.combine, self.fan_in = path, schema, partition_by, combine, fan_in

    # Folders

    def _where(self, spark: SparkSession, path: str):
        """The file system of a path and the path, as Hadoop objects."""
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where

    def _folder(self, level: int, number: int) -> str:
        return f"{self.path}/run=b{level}_{number}"

    def _finished(self, spark: SparkSession) -> dict[int, list[int]]:
        """Numbers of the finished folders of each level."""
        files, where = self._where(spark, self.path)
        found: dict[int, list[int]] = {}
        for status in files.listStatus(where) if files.exists(where) else []:
            name = status.getPath().getName()
            done = files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS"))
            if name.startswith("run=b") and done:
                level, number = name.removeprefix("run=b").split("_")
                found.setdefault(int(level), []).append(int(number))
        return found

    def folders(self, spark: SparkSession, before: int | None = None) -> list[str]:
        """The folders that together hold every batch (before one) once: the longest runs, and what none of them covers."""
        finished, covered, found = self._finished(spark), [], []
        for level in sorted(finished, reverse=True):
            free = [n for n in sorted(finished[level]) if (before is None or n < before) and not any(n in c for c in covered)]
            found += [self._folder(level, n) for n in free]
            covered += [range(n - self.fan_in**level + 1, n + 1) for n in free]
        return found

    # Rows

    def _read(self, spark: SparkSession, folders: list[str]) -> DataFrame:
        if not folders:
            return spark.createDataFrame([], self.schema)
        rows = spark.read.schema(self.schema).option("basePath", self.path).parquet(*folders)
        rows = rows.select(*self.schema.names)
        return self.combine(rows) if self.combine and len(folders) > 1 else rows

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """What all batches (before one) wrote, combined."""
        return self._read(spark, self.folders(spark, before))

    def batch(self, spark: SparkSession, number: int) -> DataFrame:
        """What one batch wrote; its folder is there until the merge after next."""
        return self._read(spark, [self._folder(0, number)])

    def _write(self, rows: DataFrame, level: int, number: int) -> None:
        rows = rows.select(*self.schema.names)
        if self.partition_by:
            rows = rows.hint("rebalance", self.partition_by)
        writer = rows.write.mode("overwrite")
        writer = writer.partitionBy(self.partition_by) if self.partition_by else writer
        writer.parquet(self._folder(level, number))

    def add(self, rows: DataFrame, number: int) -> None:
        """Write the rows of a batch in its folder, then merge what is complete."""
        spark = rows.sparkSession
        self._write(rows, 0, number)
        level = 1
        while (number + 1) % self.fan_in**level == 0:
            span, part = self.fan_in**level, self.fan_in ** (level - 1)
            inputs = [n for n in self._finished(spark).get(level - 1, []) if number - span < n <= number]
            if len(inputs) == self.fan_in:  # else a batch was left out, and its neighbours stay as they are
                self._write(self._read(spark, [self._folder(level - 1, n) for n in sorted(inputs)]), level, number)
                files, _ = self._where(spark, self.path)
                finished = self._finished(spark)
                earlier = [range(n - span + 1, n + 1) for n in finished[level] if n < number]
                for n in finished[level - 1]:
                    if any(n in merged for merged in earlier):
                        files.delete(self._where(spark, self._folder(level - 1, n))[1], True)
            level += 1


def summed(*counts: str) -> Callable[[DataFrame], DataFrame]:
    """Adds up counts over all other columns."""

    def combine(rows: DataFrame) -> DataFrame:
        keys = [c for c in rows.columns if c not in counts]
        return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])

    return combine


def latest(key: str, version: str) -> Callable[[DataFrame], DataFrame]:
    """Keeps of each key the rows of its highest version."""

    def combine(rows: DataFrame) -> DataFrame:
        last = rows.groupBy(F.col(key).alias("key_of_last")).agg(F.max(version).alias("last"))
        same = (F.col(key) == F.col("key_of_last")) & (F.col(version) == F.col("last"))
        return rows.join(last, same).select(*rows.columns)

    return combine
