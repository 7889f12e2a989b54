"""Event time as integer microseconds, and right-closed cells.

A step is labelled by its end, and an interval ``(start, end]`` holds its end. Integer arithmetic keeps labels exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
HOUR = 3_600 * SECOND
DAY = 24 * HOUR


def micros(stamp: Column) -> Column:
    """Microseconds since 1970 of a naive stamp."""
    return F.unix_micros(stamp.cast("timestamp"))


def stamp(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def cell_end(us: Column, step: int) -> Column:
    """Right edge of the fixed-length cell ``(edge - step, edge]`` that holds a time, before 1970 too."""
    return us + F.pmod(-us, F.lit(step))


def month_end(at: Column) -> Column:
    """Right edge of the calendar month ``(first, next first]`` that holds a naive stamp."""
    first = F.date_trunc("month", at)
    return F.when(first == at.cast("timestamp"), first).otherwise(F.add_months(first.cast("date"), 1).cast("timestamp")).cast("timestamp_ntz")


def year_end(at: Column) -> Column:
    """Right edge of the calendar year that holds a naive stamp."""
    first = F.date_trunc("year", at)
    return F.when(first == at.cast("timestamp"), first).otherwise(F.add_months(first.cast("date"), 12).cast("timestamp")).cast("timestamp_ntz")


def week_of_year(day: Column) -> Column:
    """Weeks of seven days from 1 January, the last taking the days that are left (1 to 52)."""
    return F.least(F.floor((F.dayofyear(day) - 1) / 7) + 1, F.lit(52)).cast("int")


def iso_week(day: Column) -> Column:
    """ISO weeks, with week 53 counted to 52."""
    return F.least(F.weekofyear(day), F.lit(52)).cast("int")


def season(at: Column) -> Column:
    """0 for December to February, and so on by quarters of three months."""
    return F.floor(F.pmod(F.month(at), F.lit(12)) / 3).cast("int")
