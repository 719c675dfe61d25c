"""Reliable shared storage for intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only where the setting is absent (a test session on one machine) is a temporary
    folder created and set.
    """
    context = spark.sparkContext
    named, current = spark.conf.get("spark.checkpoint.dir", None), context.getCheckpointDir()
    if not named and not current:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="weirlog-")
    if not current:
        context.setCheckpointDir(named)
    return named or current


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark).rstrip('/')}/weirlog-{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Write a small intermediate result to the shared folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
