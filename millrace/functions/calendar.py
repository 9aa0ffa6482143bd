"""Date and time Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(ts: Column) -> dict[str, Column]:
    """Year, quarter, month, weekday, hour, part of day and ``yyyy-MM``; null for null."""
    return {
        "year": F.year(ts), "quarter": F.quarter(ts), "month": F.month(ts), "weekday": F.date_format(ts, "EEEE"), "hour": F.hour(ts),
        "part_of_day": part_of_day(ts), "year_month": F.date_format(ts, "yyyy-MM"),
    }


def part_of_day(ts: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ("night", "morning", "afternoon", "evening"))), (F.floor(F.hour(ts) / 6) + 1).cast("int"))


def quarter_label(ts: Column) -> Column:
    return F.concat(F.year(ts).cast("string"), F.lit(" Q"), F.quarter(ts).cast("string"))


def bucket(ts: Column, unit: str) -> Column:
    """The start of the minute, hour or day as text."""
    formats = {"minute": "yyyy-MM-dd HH:mm:00", "hour": "yyyy-MM-dd HH:00:00", "day": "yyyy-MM-dd"}
    return F.date_format(ts, formats[unit])


def parse_range(text: str) -> tuple[int, str]:
    """``30d``, ``12h`` or ``15m`` as (number, unit); an unknown unit counts as days, no number as 30."""
    m = re.match(r"\s*(\d+)\s*([a-zA-Z]?)", text or "")
    if not m:
        return 30, "day"
    return int(m[1]), {"m": "minute", "h": "hour"}.get(m[2].lower(), "day")


def whole_days(start: Column, end: Column) -> Column:
    """Whole 24-hour days between two times."""
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / 86_400_000_000)


def months_since(ts: Column, start: Column) -> Column:
    return (F.months_between(F.trunc(ts, "month"), F.trunc(start, "month"))).cast("int")


def render_time(server_ms: Column, form_ms: Column) -> Column:
    """Milliseconds between showing and sending a form."""
    return server_ms - form_ms
