"""Calendar expressions: ISO weekday, day type, night hours, month length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cityrhythm import dims


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def iso_weekday(date: Column | str) -> Column:
    """1 = Monday .. 7 = Sunday (``dayofweek`` would start on Sunday)."""
    return (F.weekday(_c(date)) + 1).cast("int")


def day_type(date: Column | str) -> Column:
    """Weekday label for ISO weekday <= 5, weekend label otherwise."""
    return F.when(iso_weekday(date) <= 5, F.lit(dims.WEEKDAY)).otherwise(F.lit(dims.WEEKEND))


def is_night(hour: Column | str) -> Column:
    h = _c(hour)
    return (h >= dims.NIGHT_FROM) | (h < dims.NIGHT_UNTIL)


def days_in_month(date: Column | str) -> Column:
    """Number of calendar days in the month of ``date``."""
    return F.dayofmonth(F.last_day(_c(date))).cast("int")
