"""Timestamps written in other formats than ISO, as wall-clock time whatever the session's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = "ISO"

#: Date formats in the order in which a value is tried on them (so month before day): what their text looks like, and
#: which of its parts are year, month and day.
DATE_FORMATS = {
    "yyyy/MM/dd": (r"(\d{4})/(\d{1,2})/(\d{1,2})", (1, 2, 3)),
    "yyyy.MM.dd": (r"(\d{4})\.(\d{1,2})\.(\d{1,2})", (1, 2, 3)),
    "yyyyMMdd": (r"(\d{4})(\d{2})(\d{2})", (1, 2, 3)),
    "MM/dd/yyyy": (r"(\d{1,2})/(\d{1,2})/(\d{4})", (3, 1, 2)),
    "dd/MM/yyyy": (r"(\d{1,2})/(\d{1,2})/(\d{4})", (3, 2, 1)),
    "MM-dd-yyyy": (r"(\d{1,2})-(\d{1,2})-(\d{4})", (3, 1, 2)),
    "dd-MM-yyyy": (r"(\d{1,2})-(\d{1,2})-(\d{4})", (3, 2, 1)),
    "MM.dd.yyyy": (r"(\d{1,2})\.(\d{1,2})\.(\d{4})", (3, 1, 2)),
    "dd.MM.yyyy": (r"(\d{1,2})\.(\d{1,2})\.(\d{4})", (3, 2, 1)),
    "dd MMM yyyy": (r"(\d{1,2})[ -]([A-Za-z]{3})[ -](\d{4})", (3, 2, 1)),
    "MMM dd, yyyy": (r"([A-Za-z]{3}) (\d{1,2}),? (\d{4})", (3, 1, 2)),
    "dd/MMM/yyyy": (r"(\d{1,2})/([A-Za-z]{3})/(\d{4})", (3, 2, 1)),
}
FORMATS = (ISO, *DATE_FORMATS)
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"
#: A time of day behind a date.
_CLOCK = r"(?:(?:, ?| +|T|:)(\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?))?"


def parse_timestamp(text: Column, date_format: str = ISO) -> Column:
    """TIMESTAMP_NTZ of text whose date has one of ``FORMATS``; null where it has not, or where there is no such day or time.

    A date may stand alone (midnight) or be followed by a time of day, of 24 hours or of 12 with AM or PM. Names of
    months have three letters of any case. Blanks around the value do not count. The text is turned into ISO text,
    which the cast then checks.
    """
    if date_format == ISO:
        return text.try_cast("timestamp_ntz")
    if date_format not in DATE_FORMATS:
        raise ValueError(f"unknown timestamp format {date_format!r}; known: {', '.join(FORMATS)}")
    return _parsed(*split_half(text), date_format)


def split_half(text: Column) -> tuple[Column, Column]:
    """A value without blanks around it and AM or PM at its end, and which of the two it has (else empty)."""
    whole = F.trim(text)
    half = F.lower(F.right(whole, F.lit(2)))
    half = F.when(half.isin("am", "pm"), half).otherwise(F.lit(""))
    return F.rtrim(F.substring(whole, F.lit(1), F.length(whole) - F.length(half))), half


def _parsed(value: Column, half: Column, date_format: str) -> Column:
    shape, (year, month, day) = DATE_FORMATS[date_format]
    if "MMM" in date_format:
        name = F.lower(F.regexp_extract(value, f"^{shape}", month))
        number = F.when(name != "", ((F.instr(F.lit(_MONTHS), name) + 3) / 4).try_cast("int").cast("string"))
        iso = F.regexp_replace(value, f"^{shape}{_CLOCK}$", f"${year}-MM-${day} $4")
        iso = F.when(iso != value, F.replace(iso, F.lit("MM"), number))
    else:
        iso = F.regexp_replace(value, f"^{shape}{_CLOCK}$", f"${year}-${month}-${day} $4")
        iso = F.when(iso != value, iso)
    at = iso.try_cast("timestamp_ntz")
    hour = F.hour(at)
    shift = F.when((half == "pm") & (hour < 12), 12).when((half == "am") & (hour == 12), -12).otherwise(0)
    return F.when((half == "") | hour.between(1, 12), at + F.make_dt_interval(hours=shift))


def fitting_formats(value: Column, half: Column, is_iso: Column) -> Column:
    """Names of the ``FORMATS`` that a value (see ``split_half``) fits, in their order; ISO text is tried on no other."""
    fits = [F.when(_parsed(value, half, name).isNotNull(), F.lit(name)) for name in DATE_FORMATS]
    return F.when(is_iso, F.array(F.lit(ISO))).otherwise(F.array_compact(F.array(*fits)))


def wall_clock_micros(ts: Column) -> Column:
    """Microseconds since 1970 on the clock that a TIMESTAMP_NTZ shows."""
    seconds = (F.unix_date(F.to_date(ts)).cast("bigint") * 24 + F.hour(ts)) * 3600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
