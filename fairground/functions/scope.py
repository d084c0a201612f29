"""Scope and calendar predicates of the report queries."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def day_range(date: str) -> tuple[Column, Column]:
    """Seconds of local midnight and 86,400 s later, which on days of a clock change isn't midnight."""
    start = F.unix_timestamp(F.lit(f"{date} 00:00:00")).cast("double")
    return start, start + 86400


def local_day(ts: Column | str) -> Column:
    """The calendar day in the session's time zone, as ISO text."""
    return F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd")


def scope(df: DataFrame, event_id=None, booth_id=None, date: str | None = None, camera_id=None, ts: str = "ts") -> DataFrame:
    """Rows of an event, a booth, a camera, a day; what isn't given doesn't filter."""
    for name, value in (("event_id", event_id), ("booth_id", booth_id), ("camera_id", camera_id)):
        if value not in (None, ""):
            if name not in df.columns:
                raise ValueError(f"these rows have no {name}")
            df = df.where(F.col(name) == value)
    if date:
        start, end = day_range(date)
        df = df.where((F.col(ts) >= start) & (F.col(ts) < end))
    return df


def period_start(period: str, now: datetime, reset: datetime | None = None) -> float:
    """Where a period begins that counts calendar days, today included. `today` begins at a manual
    reset, if one was made since midnight."""
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    if period == "all":
        return 0.0
    if period == "today":
        return (reset if reset is not None and midnight < reset <= now else midnight).timestamp()
    if period not in ("7d", "30d"):
        raise ValueError(f"period {period!r} is not one of today, 7d, 30d, all")
    return (midnight - timedelta(days=int(period[:-1]) - 1)).timestamp()


def not_merged(identity: Column | str) -> Column:
    """Identities that weren't merged into others."""
    return ~F.startswith(F.lower(identity), F.lit("merged:"))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")
