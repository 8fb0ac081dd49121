"""Calendars without leap days (noleap) and of twelve 30-day months (360_day), as day-number arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days before each month of a year without leap day.
_BEFORE = (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334)
CALENDARS = ("noleap", "360_day")


def _table() -> Column:
    return F.array(*[F.lit(d) for d in _BEFORE])


def day_number(year: Column, month: Column, day: Column, calendar: str) -> Column:
    """Days since year 0."""
    if calendar == "360_day":
        return (year * 360 + (month - 1) * 30 + day - 1).cast("long")
    if calendar == "noleap":
        return (year * 365 + F.get(_table(), (month - 1).cast("int")) + day - 1).cast("long")
    raise ValueError(f"unknown calendar {calendar}")


def from_day_number(n: Column, calendar: str) -> Column:
    """struct(year, month, day)."""
    size = {"360_day": 360, "noleap": 365}[calendar]
    rest = F.pmod(n, F.lit(size)).cast("int")
    year = ((n - rest) / size).cast("int")
    if calendar == "360_day":
        month, day = (rest - rest % 30) / 30 + 1, rest % 30 + 1
    else:
        month = F.size(F.filter(_table(), lambda b: b <= rest))
        day = rest - F.get(_table(), month - 1) + 1
    return F.struct(year.alias("year"), month.cast("int").alias("month"), day.cast("int").alias("day"))
