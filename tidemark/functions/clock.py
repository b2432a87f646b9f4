"""Time arithmetic on timestamp columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hours_between(start: Column, end: Column) -> Column:
    """Whole seconds from start to end, in hours."""
    return F.timestamp_diff("SECOND", start, end) / F.lit(3600.0)


def whole_minutes(start: Column, end: Column) -> Column:
    """Whole minutes from start to end, cut towards zero."""
    return F.timestamp_diff("MINUTE", start, end)


def null_before(column: Column, bound: str) -> Column:
    """NULL for the sentinel values before ``bound``."""
    return F.when(column < F.lit(bound).cast("timestamp"), F.lit(None)).otherwise(column)


def null_after(column: Column, bound: str) -> Column:
    """NULL for the sentinel values after ``bound``."""
    return F.when(column > F.lit(bound).cast("timestamp"), F.lit(None)).otherwise(column)


def hex_millis(column: Column) -> Column:
    """Milliseconds since 1970 as at least 12 hexadecimal digits, '-' before 1970."""
    millis = F.unix_millis(column.cast("timestamp"))
    return F.when(millis < 0, F.format_string("-%011x", -millis)).otherwise(
        F.format_string("%012x", millis)
    )
