"""Times as whole microseconds."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE = 60_000_000
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def micros(c: str | Column) -> Column:
    """Microseconds since the epoch. Times without a zone count in the session's, which should be UTC."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def duration(value: str | float | timedelta, unit: int = MINUTE) -> int:
    """Microseconds of a timedelta, of a number of units (minutes unless stated), or of text such as "10min", "2h" or "1D"."""
    if isinstance(value, timedelta):
        return value // timedelta(microseconds=1)
    if isinstance(value, bool) or value is None:
        raise TypeError(f"not a duration: {value!r}")
    if isinstance(value, (int, float)):
        return round(value * unit)
    if isinstance(value, str):
        number = value.rstrip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ ")
        name = value[len(number) :].strip()
        units = {"us": 1, "ms": 1000, "s": 1_000_000, "sec": 1_000_000, "min": MINUTE, "m": MINUTE, "T": MINUTE, "h": HOUR, "H": HOUR, "hours": HOUR, "D": DAY, "d": DAY, "days": DAY, "W": 7 * DAY}
        if name in units:
            return round(float(number or 1) * units[name])
    raise TypeError(f"not a duration: {value!r}")


def overlap_ratio(start_1: Column, end_1: Column, start_2: Column, end_2: Column) -> Column:
    """Share of the first period (microseconds) that the second covers; 0 for an empty or negative first period."""
    both = F.greatest(F.lit(0), F.least(end_1, end_2) - F.greatest(start_1, start_2))
    return F.when(end_1 > start_1, both / (end_1 - start_1)).otherwise(F.lit(0.0))
