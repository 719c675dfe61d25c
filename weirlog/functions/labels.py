"""Text shown to people: display names and change labels (formats are fixed values)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import UNKNOWN, UNKNOWN_ENDPOINT, UNKNOWN_SERVICE
from .numbers import fixed_text, screen_text


def _renamed(x: Column, value: str, shown: str) -> Column:
    return F.when(x == value, F.lit(shown)).otherwise(x)


def service_label(x: Column) -> Column:
    return _renamed(x, UNKNOWN_SERVICE, "Unknown Service")


def endpoint_label(x: Column) -> Column:
    return _renamed(x, UNKNOWN_ENDPOINT, "Unknown Endpoint")


def release_label(x: Column) -> Column:
    return _renamed(x, UNKNOWN, "Unclassified")


def region_label(x: Column) -> Column:
    return _renamed(x, UNKNOWN, "Unclassified")


def change_label(points: Column, unit: str) -> Column:
    arrow = F.when(points > 0, F.lit("↑")).otherwise(F.lit("↓"))
    return F.when(F.abs(points) < 0.05, F.lit("Flat vs previous period")).otherwise(
        F.concat(arrow, F.lit(" "), screen_text(F.abs(points), 1), F.lit(f"{unit} vs previous period"))
    )


def change_cell(value: Column, unit: str) -> Column:
    sign = F.when(value > 0, F.lit("+")).otherwise(F.lit(""))
    return F.when(F.abs(value) < 0.05, F.lit(f"0{unit}")).otherwise(
        F.concat(sign, fixed_text(value, 2), F.lit(unit))
    )


def seconds_label(ms: Column) -> Column:
    return F.concat(screen_text(ms / 1000.0, 2), F.lit("s"))


def detection_summary(created: Column, already_open: Column) -> Column:
    def plural(n: Column, suffix: str) -> Column:
        return F.when(n == 1, F.lit("")).otherwise(F.lit(suffix))

    open_tail = F.when(
        already_open > 0, F.concat(F.lit(" · "), already_open.cast("string"), F.lit(" already open"))
    ).otherwise(F.lit(""))
    return (
        F.when(
            created > 0,
            F.concat(
                created.cast("string"), F.lit(" new incident"), plural(created, "s"), F.lit(" created"), open_tail
            ),
        )
        .when(
            already_open > 0,
            F.concat(
                F.lit("No new incidents — "),
                already_open.cast("string"),
                F.lit(" violation"),
                plural(already_open, "s"),
                F.lit(" already have an open incident"),
            ),
        )
        .otherwise(F.lit("No threshold violations found"))
    )
