"""Shop calendar helpers."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shop_day(ts: Column, offset_hours: int = 0) -> Column:
    """Start of the shop day holding ``ts``: days begin ``offset_hours`` after midnight."""
    if offset_hours == 0:
        return F.date_trunc("day", ts).cast("timestamp_ntz")
    shifted = ts - F.make_dt_interval(F.lit(0), F.lit(offset_hours))
    return (F.date_trunc("day", shifted).cast("timestamp_ntz")
            + F.make_dt_interval(F.lit(0), F.lit(offset_hours)))


def hours_between(a: Column, b: Column) -> Column:
    """(b - a) in hours as double."""
    return F.timestamp_diff("MICROSECOND", a, b) / F.lit(3_600_000_000.0)


def seconds_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b) / F.lit(1_000_000.0)


def add_seconds(ts: Column, secs: Column) -> Column:
    return F.timestamp_add("SECOND", secs, ts)


def add_hours(ts: Column, hours: Column) -> Column:
    return F.timestamp_add("HOUR", hours, ts)


def ntz(value) -> Column:
    """A TIMESTAMP_NTZ literal from a datetime, independent of any time zone setting."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
