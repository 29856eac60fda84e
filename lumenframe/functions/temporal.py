"""Dates, times and zones. Clock values are timestamps without zone."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Format letters after % and the Spark date pattern of each.
PATTERNS = {
    "Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "h": "MMM",
    "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "p": "a", "I": "hh", "z": "xx",
    "F": "yyyy-MM-dd", "T": "HH:mm:ss", "f": "SSSSSS", "%": "%",
}


def pattern(fmt: str) -> str:
    """A % format as a Spark pattern; plain words are quoted."""
    pieces = re.findall(r"%(.)|([A-Za-z]+)|([^%A-Za-z]+)", fmt, re.DOTALL)
    return "".join(PATTERNS[code] if code else f"'{word}'" if word else other.replace("'", "''") for code, word, other in pieces)


def format_time(c: Column, fmt: str) -> Column:
    return F.date_format(c, pattern(fmt))


def parse_date(c: Column, fmt: str, strict: bool = True) -> Column:
    return F.to_date(c, pattern(fmt)) if strict else F.try_to_date(c, pattern(fmt))


def parse_datetime(c: Column, fmt: str, strict: bool = True) -> Column:
    p = F.lit(pattern(fmt))
    return (F.to_timestamp_ntz(c, p) if strict else F.try_to_timestamp(c, p).cast("timestamp_ntz"))


def parse_offset(c: Column, fmt: str, zone: str) -> Column:
    """Texts with mixed UTC offsets as clock times of one zone (session in UTC)."""
    instant = F.to_timestamp(c, pattern(fmt)).cast("timestamp_ntz")
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), instant)


def zone_convert(c: Column, source: str, target: str) -> Column:
    """Clock time in another zone at the same instant."""
    return F.convert_timezone(F.lit(source), F.lit(target), c)


def zone_instant(c: Column, zone: str) -> Column:
    """UTC clock of the instant at which `zone` shows this clock time."""
    return F.to_utc_timestamp(c.cast("timestamp"), zone).cast("timestamp_ntz")


def nanos_of_day(c: Column) -> Column:
    t = c.cast("timestamp")
    return F.pmod(F.unix_micros(t), F.lit(86_400_000_000)) * 1000


def decade(c: Column) -> Column:
    return (F.floor(F.year(c) / 10) * 10).cast("bigint")


def days_inclusive(low: Column, high: Column) -> Column:
    return F.datediff(high, low) + 1
