import random
from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirlog.functions import labels, numbers, status


@pytest.fixture(scope="module")
def doubles(spark):
    random.seed(7)
    ties = [2.675, 0.125, 0.375, 1.005, 0.25, 0.35, 0.45, 0.75, 11.655, 2.5, 0.5, -0.125, -2.675, 0.0]
    divisors = (3, 7, 8, 16, 40, 200, 800, 1600)
    values = ties + [random.randint(0, 10**6) / random.choice(divisors) for _ in range(20_000)]
    return spark.createDataFrame([(v,) for v in values], "x double")


def exact(x, digits, rounding):
    return Decimal(x).quantize(Decimal(1).scaleb(-digits), rounding=rounding)


def test_figures_round_the_exact_binary_value(doubles):
    for digits in (1, 2):
        for row in doubles.select("x", numbers.round_figure(F.col("x"), digits).alias("r")).collect():
            assert row.r == round(row.x, digits)


def test_table_cells_round_like_scaled_rint(doubles):
    for row in doubles.select("x", numbers.round_table(F.col("x")).alias("r")).collect():
        assert row.r == float(np.round(row.x, 2))


def test_texts(doubles):
    columns = [
        numbers.fixed_text(F.col("x"), 0).alias("f0"),
        numbers.fixed_text(F.col("x"), 1).alias("f1"),
        numbers.screen_text(F.col("x"), 1).alias("s1"),
        numbers.screen_text(F.col("x"), 2).alias("s2"),
    ]
    for row in doubles.where("x >= 0").select("x", *columns).collect():
        assert row.f0 == f"{row.x:.0f}" == str(exact(row.x, 0, ROUND_HALF_EVEN))
        assert row.f1 == f"{row.x:.1f}"
        assert row.s1 == str(exact(row.x, 1, ROUND_HALF_UP))
        assert row.s2 == str(exact(row.x, 2, ROUND_HALF_UP))


def test_percent_change_of_zero(spark):
    row = spark.range(1).select(
        numbers.percent_change(F.lit(0.0), F.lit(5.0)).alias("zero"),
        numbers.percent_change(F.lit(200.0), F.lit(250.0)).alias("up"),
        numbers.percent_of(F.lit(0), F.lit(0)).alias("none"),
    )
    assert tuple(row.first()) == (0.0, 25.0, 0.0)


@pytest.mark.parametrize(
    "error, p95, expected",
    [(5.0, 10.0, "Degraded"), (5.01, 10.0, "Critical"), (2.0, 1000.0, "Healthy"), (2.1, 0.0, "Degraded"),
     (0.0, 2000.0, "Degraded"), (0.0, 2000.5, "Critical"), (0.0, 1000.5, "Degraded")],
)
def test_health_limits_are_strict(spark, error, p95, expected):
    named = spark.range(1).select(
        status.health_class(F.lit(error), F.lit(p95)).alias("h"),
        status.service_health(F.lit("unknown-service"), F.lit(error), F.lit(p95)).alias("u"),
    )
    assert tuple(named.first()) == (expected, "Unknown")


def test_bands_and_verdicts(spark):
    row = spark.range(1).select(
        status.error_rate_band(F.lit(10.0)),
        status.error_rate_band(F.lit(3.0)),
        status.availability_band(F.lit(99.0)),
        status.availability_band(F.lit(95.0)),
        status.regression_verdict(F.lit(False), F.lit(90.0), F.lit(0.0)),
        status.regression_verdict(F.lit(True), F.lit(-50.1), F.lit(0.0)),
        status.regression_verdict(F.lit(True), F.lit(50.0), F.lit(21.0)),
    )
    assert tuple(row.first()) == (
        "warning", "healthy", "warning", "critical", "Stable", "Regression", "Minor Regression",
    )


def test_change_labels(spark):
    row = spark.range(1).select(
        labels.change_label(F.lit(0.04), "pt"),
        labels.change_label(F.lit(0.25), "pt"),
        labels.change_label(F.lit(-0.35), "%"),
        labels.change_cell(F.lit(-0.04), "%"),
        labels.change_cell(F.lit(1.5), "pt"),
        labels.change_cell(F.lit(-39.03), "%"),
        labels.seconds_label(F.lit(1235.0)),
    )
    assert tuple(row.first()) == (
        "Flat vs previous period", "↑ 0.3pt vs previous period", "↓ 0.3% vs previous period",
        "0%", "+1.50pt", "-39.03%", "1.24s",
    )


@pytest.mark.parametrize(
    "created, known, text",
    [(0, 0, "No threshold violations found"), (1, 0, "1 new incident created"),
     (2, 3, "2 new incidents created · 3 already open"),
     (0, 1, "No new incidents — 1 violation already have an open incident")],
)
def test_detection_summary(spark, created, known, text):
    counts = spark.createDataFrame([(created, known)], "c bigint, k bigint")
    assert counts.select(labels.detection_summary(F.col("c"), F.col("k"))).first()[0] == text


def test_reliability(spark):
    score = spark.range(1).select(status.reliability(F.lit(632.0), F.lit(1.2), 1500.0).alias("s")).select("s.*").first()
    assert tuple(score) == (57.9, 88.0, 98.8, 78.1, "Degraded")
    none = spark.range(1).select(status.reliability(F.lit(0.0), F.lit(0.0), 0.0).alias("s")).select("s.*").first()
    assert tuple(none) == (100.0, 100.0, 100.0, 100.0, "Healthy")
