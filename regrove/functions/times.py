"""Epoch arithmetic on wall-clock fields, so a zone-less timestamp does not meet the session zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wall_seconds(ts: Column) -> Column:
    """Whole seconds since 1970-01-01 00:00 on the timestamp's own clock."""
    day = F.unix_date(F.to_date(ts)).cast("long")
    return day * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def wall_millis(ts: Column) -> Column:
    fraction = F.date_part(F.lit("SECOND"), ts) - F.second(ts)
    return wall_seconds(ts) * 1000 + F.floor(fraction * 1000).cast("long")
