"""Text normalisation for raw log fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import UNKNOWN_ENDPOINT

# Every character that counts as white space when a field is stripped.
WHITESPACE = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]
        + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(WHITESPACE))


def default_if_blank(x: Column, default: str) -> Column:
    """Stripped text, or ``default`` for null and blank. Case is kept."""
    return F.coalesce(F.nullif(strip(x), F.lit("")), F.lit(default))


def normalize_endpoint(x: Column) -> Column:
    """Stripped and lowercased path without trailing slashes; a bare ``/`` stays."""
    path = F.lower(strip(x))
    return (
        F.when(path.isNull() | (path == ""), F.lit(UNKNOWN_ENDPOINT))
        .when(path == "/", path)
        .otherwise(F.rtrim(path, F.lit("/")))
    )


def to_number(x: Column) -> Column:
    """Numeric text as DOUBLE; anything else becomes null.

    The cast would also take Java suffixes (``200d``) and the words for infinity and
    not-a-number. No plain number contains their letters, so these are blotted out
    first, in one pass and without a regular expression.
    """
    return F.translate(x, "dDfFnN", "??????").try_cast("double")
