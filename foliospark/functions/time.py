"""Time buckets, weeks and years."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hours by which dashboards shift UTC before cutting it into buckets.
SHIFT_HOURS = 8


def bucket(ts: Column, unit: str, shift_hours: int = SHIFT_HOURS) -> Column:
    """"2024-01-05 13:00", ISO "2024-01" (year of the week, week) or "2024-01-05"."""
    t = ts + F.make_dt_interval(hours=F.lit(shift_hours))
    if unit == "hour":
        return F.date_format(t, "yyyy-MM-dd HH:00")
    if unit == "week":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), t).cast("string"), F.lit("-"), F.lpad(F.weekofyear(t).cast("string"), 2, "0"))
    return F.date_format(t, "yyyy-MM-dd")


def year_of(c: Column) -> Column:
    """A year written as text or number, "2019.0" too; NULL if it isn't a number."""
    return F.try_to_number(F.regexp_extract(F.trim(c.cast("string")), r"^(\d{1,9})(?:\.\d*)?$", 1), F.lit("999999999")).cast("int")


def days_before(ts: Column, now: Column) -> Column:
    """Whole days between: 0 for the last 24 hours."""
    past = F.timestamp_diff("MICROSECOND", ts.cast("timestamp_ntz"), now.cast("timestamp_ntz"))
    return F.floor(past / 86_400_000_000).cast("int")


def millis(ts: Column) -> Column:
    """Milliseconds since 1970, whatever the session's time zone for a time without zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


#: Hours that times without a zone are ahead of UTC.
LOCAL_HOURS = 8


def to_utc(c: Column, local_hours: int = LOCAL_HOURS) -> Column:
    """UTC, as a time without zone, of ISO 8601 texts and of numbers of seconds since 1970; null for anything else.

    A text may end with Z or an offset; one without is local time. A date alone is its midnight.
    """
    raw = F.trim(c.cast("string"))
    iso = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?))?(Z|[+-]\d{2}:?\d{2})?$"
    day, clock, zone = (F.regexp_extract(raw, iso, k) for k in (1, 2, 3))
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    minutes = F.when(zone == "", local_hours * 60).when(zone == "Z", 0).otherwise(sign * (F.substring(zone, 2, 2).try_cast("int") * 60 + F.right(zone, F.lit(2)).try_cast("int")))
    local = F.concat_ws(" ", day, F.when(clock != "", clock).otherwise("00:00")).try_cast("timestamp_ntz")
    seconds = F.when(raw.rlike(r"^-?\d+(\.\d+)?$"), raw.try_cast("decimal(20,6)"))
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.coalesce(local - F.make_dt_interval(mins=minutes), epoch + F.make_dt_interval(secs=seconds))
