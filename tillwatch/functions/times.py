"""Time arithmetic on epoch microseconds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SECOND = 1_000_000
HOUR = 3600 * SECOND
DAY = 24 * HOUR
NO_HISTORY_DAYS = 9999.0


def micros(ts) -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def hours_between(later_us: Column, earlier_us: Column) -> Column:
    return (later_us - earlier_us) / F.lit(float(HOUR))


def whole_second_hours(later_us: Column, earlier_us: Column) -> Column:
    """The streaming variant of account age: seconds truncated toward zero."""
    gap = later_us - earlier_us
    seconds = F.signum(gap) * F.floor(F.abs(gap) / F.lit(SECOND))
    return seconds / F.lit(3600.0)


def days_between(later_us: Column, earlier_us: Column) -> Column:
    return (later_us - earlier_us) / F.lit(float(DAY))
