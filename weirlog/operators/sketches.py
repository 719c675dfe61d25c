"""Request figures in mergeable sketches: bounded size per group, whatever its requests.

Counts, sums and maxima are exact. Latency quantiles come from a KLL sketch, numbers of different
endpoints from a HyperLogLog sketch. Sketches of days, services or batches are merged without going back to
rows; a merged HyperLogLog sketch estimates what one sketch over all rows would, a merged
KLL sketch has the error of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import percent_of, round_figure
from ..functions.status import is_error
from ..schema import DEFAULTS
from .metrics import LATENCY

#: Size of the quantile sketch: with 1,000 the rank of a quantile is off by less than 0.3 % (with 99 % confidence), in about 10 KB.
KLL_SIZE = 1_000
#: Registers of the distinct counts as a power of two: 2^12 make a standard error of 1.6 %.
HLL_BITS = 12
QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
_SUMS = ("n", "n_4xx", "n_5xx", "slow", "sum_ms")


def request_sketches(logs: DataFrame, *keys: str | Column, slow_threshold_ms: int = DEFAULTS.slow_request_ms) -> DataFrame:
    """One row of sums and sketches per group, by partial sketches in the tasks."""
    code, ms = F.col("status_code"), F.col(LATENCY)
    return logs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(is_error(code) & (code < 500)).alias("n_4xx"),
        F.count_if(code >= 500).alias("n_5xx"),
        F.count_if(ms > slow_threshold_ms).alias("slow"),
        F.sum(ms).alias("sum_ms"),
        F.max(ms).alias("max_ms"),
        F.kll_sketch_agg_bigint(ms, KLL_SIZE).alias("latencies"),
        F.hll_sketch_agg("endpoint", HLL_BITS).alias("endpoints"),
    )


def merge_sketches(sketches: DataFrame, *keys: str) -> DataFrame:
    """The same rows for coarser groups."""
    return sketches.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in _SUMS],
        F.max("max_ms").alias("max_ms"),
        F.kll_merge_agg_bigint("latencies", KLL_SIZE).alias("latencies"),
        F.hll_union_agg("endpoints").alias("endpoints"),
    )


def figures_of_sketches(sketches: DataFrame, *keys: str) -> DataFrame:
    """KPIs of each row of sketches; quantiles are values that occur, of about the rank asked for."""
    errors = F.col("n_4xx") + F.col("n_5xx")
    rate = percent_of(errors, F.col("n"))
    return sketches.select(
        *keys,
        F.col("n").alias("total_requests"),
        round_figure(rate).alias("error_rate_percent"),
        round_figure(100 - rate).alias("availability_percent"),
        round_figure(F.col("sum_ms") / F.col("n")).alias("avg_latency_ms"),
        F.col("max_ms").alias("max_latency_ms"),
        F.col("slow").alias("slow_requests"),
        F.hll_sketch_estimate("endpoints").alias("endpoints"),
        *[F.kll_sketch_get_quantile_bigint("latencies", F.lit(q)).alias(f"{name}_latency_ms") for name, q in QUANTILES.items()],
    )


def rank_errors(figures: DataFrame, logs: DataFrame, *keys: str) -> DataFrame:
    """For each group and quantile how far the rank of the sketch's value lies from the rank asked for (0: inside the ties of the value)."""
    values = figures.select(*keys, F.explode(_named_quantiles()).alias("quantile", "value")).select(*keys, "quantile", "value")
    counts = logs.groupBy(*keys, F.col(LATENCY).alias("ms")).agg(F.count(F.lit(1)).alias("n"))
    # Equal sizes on both sides are small: one row per group and quantile, and per group and latency value.
    met = counts.join(values, list(keys)).groupBy(*keys, "quantile")
    below, upto, all_ = (F.sum(F.when(c, F.col("n")).otherwise(0)) for c in (F.col("ms") < F.col("value"), F.col("ms") <= F.col("value"), F.lit(True)))
    ranks = met.agg((below / all_).alias("low"), (upto / all_).alias("high"))
    q = F.element_at(F.create_map(*[F.lit(x) for pair in QUANTILES.items() for x in pair]), F.col("quantile"))
    return ranks.select(*keys, "quantile", F.greatest(F.lit(0.0), F.col("low") - q, q - F.col("high")).alias("rank_error"))


def _named_quantiles() -> Column:
    return F.create_map(*[x for name in QUANTILES for x in (F.lit(name), F.col(f"{name}_latency_ms"))])
