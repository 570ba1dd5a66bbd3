"""Store time as a parameter. Times are TIMESTAMP_NTZ; nothing here reads a clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(moment: str) -> Column:
    """The store time 'YYYY-MM-DD hh:mm:ss'."""
    return F.expr(f"TIMESTAMP_NTZ'{moment}'")


def plus_seconds(when: Column, seconds: Column | int) -> Column:
    s = F.lit(seconds) if isinstance(seconds, int) else seconds
    return when + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), s.cast("decimal(18,6)"))


def plus_days(when: Column, days: int) -> Column:
    return when + F.make_dt_interval(F.lit(days))


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from start to end, rounded down."""
    return F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(1_000_000)).cast("long")
