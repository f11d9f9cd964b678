"""Column expressions used by several jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stamp(ts: Column) -> Column:
    """A time as text to the second."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def seconds(ts: Column) -> Column:
    """Whole seconds of a zone-less time since 1970."""
    return F.unix_timestamp(ts.cast("timestamp"))


def exact_seconds(ts: Column) -> Column:
    """Seconds of a zone-less time since 1970, with fractions."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def from_seconds(s: Column) -> Column:
    return F.timestamp_seconds(s).cast("timestamp_ntz")


def access_number(name: Column) -> Column:
    """The number that a line's or access's name starts with."""
    digits = F.regexp_extract(name, r"^\s*(\d+)", 1)
    return F.when(digits != "", digits.cast("int"))


def quarter_minute(label: Column) -> Column:
    """Minute of the day at which a label such as 4:45 PM - 5:00 PM begins; null for other text."""
    hour = F.regexp_extract(label, r"^\s*(\d{1,2}):(\d{2})\s*([AaPp])", 1)
    minute = F.regexp_extract(label, r"^\s*(\d{1,2}):(\d{2})\s*([AaPp])", 2)
    half = F.upper(F.regexp_extract(label, r"^\s*(\d{1,2}):(\d{2})\s*([AaPp])", 3))
    return F.when(hour != "", (hour.cast("int") % 12 + F.when(half == "P", 12).otherwise(0)) * 60 + minute.cast("int"))


def minute_label(minute: Column) -> Column:
    """4:45 PM for 1005."""
    hour = F.floor(minute / 60).cast("int")
    shown = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    return F.concat(shown.cast("string"), F.lit(":"), F.lpad((minute % 60).cast("string"), 2, "0"), F.when(hour >= 12, F.lit(" PM")).otherwise(F.lit(" AM")))


def geh(m: Column, c: Column) -> Column:
    """GEH of two hourly flows; 0 if both are 0."""
    return F.when(m + c > 0, F.sqrt(2 * (m - c) * (m - c) / (m + c))).otherwise(F.lit(0.0))


def index_pick(sorted_values: Column, p: float) -> Column:
    """The value at place min(n - 1, int(n * p)) of a sorted array."""
    n = F.size(sorted_values)
    return F.get(sorted_values, F.least(n - 1, F.floor(n * F.lit(p)).cast("int")))
