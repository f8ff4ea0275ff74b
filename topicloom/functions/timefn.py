"""ISO-8601 text and UTC timestamps (sessions run with the UTC time zone)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_iso(text: Column) -> Column:
    return F.to_timestamp(text)


def to_iso(ts: Column) -> Column:
    """Whole seconds with a ``Z``; fractions are cut."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def whole_days(start: Column, end: Column) -> Column:
    """Complete days between two timestamps, never negative."""
    return F.greatest(
        F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(86_400_000_000)), F.lit(0)
    ).cast("long")


def next_year_start(ts: Column) -> Column:
    return F.date_trunc("year", ts) + F.expr("interval 1 year")
