"""Wall-clock and trading-calendar expressions.  Always zone-aware, never a fixed offset."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKET_ZONE = "America/New_York"


def to_et(ts: Column) -> Column:
    """UTC instant -> New York wall clock."""
    return F.from_utc_timestamp(ts, MARKET_ZONE)


def from_et(wall: Column) -> Column:
    """New York wall clock -> UTC instant."""
    return F.to_utc_timestamp(wall, MARKET_ZONE)


def minute_of_day(wall: Column) -> Column:
    return F.hour(wall) * 60 + F.minute(wall)


def next_session_date(d: Column) -> Column:
    """The date itself on weekdays, the following Monday on weekends."""
    dow = F.dayofweek(d)
    return F.date_add(d, F.when(dow == 7, 2).when(dow == 1, 1).otherwise(0))


def trading_day(ts: Column) -> Column:
    """From 18:00 in New York a candle belongs to the next weekday; weekends roll to Monday."""
    wall = to_et(ts)
    d = F.to_date(wall)
    evening = F.hour(wall) >= 18
    return next_session_date(F.date_add(d, F.when(evening, 1).otherwise(0)))


def in_window(ts: Column, start_minute: int, end_minute: int) -> Column:
    """Wall-clock window, start inclusive and end exclusive; may wrap midnight."""
    m = minute_of_day(to_et(ts))
    if start_minute < end_minute:
        return (m >= start_minute) & (m < end_minute)
    return (m >= start_minute) | (m < end_minute)


def market_open(ts: Column) -> Column:
    """Closed Saturday, Sunday before 18:00, Friday from 17:00, and 17:00-18:00 every day."""
    wall = to_et(ts)
    dow, m = F.dayofweek(wall), minute_of_day(wall)
    return (
        F.when(dow == 7, F.lit(False))
        .when(dow == 1, m >= 18 * 60)
        .when(dow == 6, m < 17 * 60)
        .otherwise(~((m >= 17 * 60) & (m < 18 * 60)))
    )


def day_start(day: Column) -> Column:
    """UTC instant at which a trading day opens: 18:00 New York on the calendar day before."""
    return from_et(F.timestamp_seconds(F.unix_date(F.date_sub(day, 1)) * 86400 + 18 * 3600))


def third_friday(month_start: Column) -> Column:
    """Third Friday of the month beginning at ``month_start``."""
    return F.date_add(F.next_day(F.date_sub(month_start, 1), "Fri"), 14)


def is_quarter_month(d: Column) -> Column:
    return F.month(d) % 3 == 0


def week_start(d: Column) -> Column:
    return F.trunc(d, "week")


def recency_bucket(published: Column, now: Column) -> Column:
    """today / week / older by New York calendar dates, undated when null."""
    age = F.datediff(F.to_date(to_et(now)), F.to_date(to_et(published)))
    return F.when(published.isNull(), "undated").when(age <= 0, "today").when(age <= 7, "week").otherwise("older")
