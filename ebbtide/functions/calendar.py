"""Time expressions. Timestamps are zone-less (``timestamp_ntz``) throughout, so no result
depends on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def parse_ts(value: Column) -> Column:
    """Timestamp, or NULL where the text is none."""
    return value.try_cast("timestamp_ntz")


def midnight(ts: Column) -> Column:
    return F.to_date(ts).cast("timestamp_ntz")


def month_start(ts: Column) -> Column:
    return F.trunc(F.to_date(ts), "month").cast("timestamp_ntz")


def month_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def week_end(ts: Column) -> Column:
    """The Sunday that closes a timestamp's Monday-to-Sunday week."""
    day = F.to_date(ts)
    return F.date_add(day, 6 - F.weekday(day)).cast("timestamp_ntz")


def minus_days(ts: Column, days: Column) -> Column:
    return ts - F.make_dt_interval(days.cast("int"))


def plus_days(ts: Column, days: int) -> Column:
    return ts + F.make_dt_interval(F.lit(days))


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole days elapsed, rounded down: 23:00 to 01:00 the next day is 0."""
    micros = F.timestamp_diff("MICROSECOND", start, end)
    return ((micros - F.pmod(micros, F.lit(DAY_MICROS))) / DAY_MICROS).cast("int")


def calendar_days(start: Column, end: Column) -> Column:
    """Days between the two dates, whatever the time of day."""
    return F.datediff(end, start)


def month_index(first: Column, then: Column) -> Column:
    """Calendar months from one timestamp's month to another's."""
    return (F.year(then) * 12 + F.month(then)) - (F.year(first) * 12 + F.month(first))


def calendar_parts(df: DataFrame, ts: str) -> DataFrame:
    at = F.col(ts)
    return df.withColumns({
        "day": midnight(at),
        "month": month_text(at),
        "month_start": month_start(at),
        "weekday": F.date_format(at, "EEEE"),
        "hour": F.hour(at),
    })
