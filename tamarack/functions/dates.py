"""Calendar days at a fixed offset, windows of days and percentages, each with its own rule for an empty denominator."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, functions as F

from tamarack.functions.text import col

OFFSET_HOURS = 8


def local_day(ts: Column | str, hours: int = OFFSET_HOURS) -> Column:
    """The calendar day at a fixed offset without daylight saving."""
    return (col(ts) + F.expr(f"INTERVAL {hours} HOURS")).cast("date")


def window_days(today: date, days: int) -> tuple[date, date, date]:
    """(first day of the window before, first day, last day) of the last 7, 30 or 90 days."""
    if days not in (7, 30, 90):
        raise ValueError("days must be 7, 30 or 90")
    start = today - timedelta(days=days - 1)
    return start - timedelta(days=days), start, today


def seconds_to_midnight(ts: Column | str, hours: int = OFFSET_HOURS) -> Column:
    day = F.date_add(local_day(ts, hours), 1).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS")
    return F.ceil(day.cast("double") - col(ts).cast("timestamp").cast("double")).cast("long")


def percent_or_zero(part: Column | str, whole: Column | str) -> Column:
    return F.when(col(whole) == 0, 0.0).otherwise(col(part).cast("double") * 100 / col(whole))


def percent_or_null(part: Column | str, whole: Column | str) -> Column:
    return F.when(col(whole) > 0, col(part).cast("double") * 100 / col(whole))


def percent_or_full(part: Column | str, whole: Column | str) -> Column:
    return F.when(col(whole) == 0, 100.0).otherwise(col(part).cast("double") * 100 / col(whole))


def goal_progress(value: Column | str, target: Column | str) -> Column:
    return F.when(col(target) <= 0, 0.0).otherwise(F.least(F.greatest(col(value).cast("double") * 100 / col(target), F.lit(0.0)), F.lit(100.0)))


def activity_level(n: Column | str) -> Column:
    """Calendar shade: none, under 5, under 20, under 50, more."""
    return F.when(col(n) <= 0, 0).when(col(n) < 5, 1).when(col(n) < 20, 2).when(col(n) < 50, 3).otherwise(4)
