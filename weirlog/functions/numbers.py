"""Rounding, ratios and number formatting.

Reports are published with two kinds of rounding. Single figures (KPI cards) round
the exact binary value half-to-even; tables round by ``rint(x * 100) / 100``. The
two differ by 0.01 near ties, so both are provided and every operator says which
one it uses.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pattern(digits: int) -> str:
    return "0" if digits == 0 else "0." + "0" * digits


def fixed_text(x: Column, digits: int) -> Column:
    """Decimal text with ``digits`` places, exact binary value, half-to-even."""
    return F.call_function("format_number", x, F.lit(_pattern(digits)))


def round_figure(x: Column, digits: int = 2) -> Column:
    """Round a single published figure: exact binary value, half-to-even."""
    return fixed_text(x.cast("double"), digits).cast("double")


def round_table(x: Column, digits: int = 2) -> Column:
    """Round a table cell: scale, round to the nearest even integer, scale back."""
    scale = float(10**digits)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def screen_text(x: Column, digits: int) -> Column:
    """Like ``fixed_text``, but exact ties go up, as number labels on screens do.

    A double lies exactly between two ``digits``-place decimals only when it is an odd
    multiple of ``2 ** -(digits + 1)``; that product is exact, so the test is too.
    """
    scaled = x * F.lit(float(2 ** (digits + 1)))
    tie = (scaled == F.floor(scaled)) & (F.pmod(scaled, F.lit(2.0)) == 1.0)
    # A tie is moved up by a tenth of the last place; anything else is left alone.
    return fixed_text(F.when(tie, x + F.lit(0.1 / 10**digits)).otherwise(x), digits)


def percent_of(part: Column, whole: Column) -> Column:
    """``part / whole * 100``; 0.0 when there is nothing to divide by."""
    return F.when(whole > 0, part / whole * 100.0).otherwise(F.lit(0.0))


def percent_change(old: Column, new: Column) -> Column:
    """Relative change in percent; 0.0 when the old value is zero."""
    return F.when(old == 0, F.lit(0.0)).otherwise((new - old) / old * 100.0)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))
