"""Reliability and stability scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import percent_of
from ..functions.status import is_error, reliability
from ..schema import DEFAULTS
from .metrics import LATENCY, latency_cells, summarize


def reliability_scores(
    logs: DataFrame, *keys: str, baseline_p95_ms: float = DEFAULTS.reliability_baseline_p95_ms
) -> DataFrame:
    """0-100 component scores, their blend and its class per group."""
    table = summarize(latency_cells(logs, *keys), *keys)
    score = reliability(F.col("p95_ms"), F.col("error_rate"), baseline_p95_ms)
    return table.select(*keys, score.alias("score")).select(*keys, "score.*")


def least_stable_endpoints(logs: DataFrame, rows: int = 10) -> DataFrame:
    """0.6 x mean latency + 0.4 x error percentage, worst first. Ties go by endpoint."""
    requests, ms = F.count(F.lit(1)), F.col(LATENCY)
    return (
        logs.groupBy("endpoint")
        .agg(
            (F.sum(ms) / requests).alias("avg_latency"),
            percent_of(F.count_if(is_error(F.col("status_code"))), requests).alias("error_rate"),
        )
        .withColumn("stability_score", F.col("avg_latency") * 0.6 + F.col("error_rate") * 0.4)
        .orderBy(F.col("stability_score").desc(), "endpoint")
        .limit(rows)
    )
