"""Days and ranges of a fixed-offset business zone over UTC timestamps. No function asks for the time of day by itself."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The business zone: nine hours ahead of UTC, without daylight saving.
ZONE = timedelta(hours=9)
_STAMP = "%Y-%m-%d %H:%M:%S"


def business_day(as_of: datetime) -> date:
    """The zone's calendar day at a UTC instant."""
    return (as_of + ZONE).date()


def day_start(day: date) -> datetime:
    """The UTC instant at which the zone's day begins."""
    return datetime(day.year, day.month, day.day) - ZONE


def named_range(kind: str, as_of: datetime) -> tuple[datetime, datetime] | None:
    """Half-open UTC range of daily or today, yesterday, weekly (from Sunday) and monthly, the last two up to today's end."""
    today = business_day(as_of)
    first = {
        "daily": today, "today": today, "yesterday": today - timedelta(days=1),
        "weekly": today - timedelta(days=(today.weekday() + 1) % 7), "monthly": today.replace(day=1),
    }.get(kind)
    if first is None:
        return None
    last = first if kind == "yesterday" else today
    return day_start(first), day_start(last + timedelta(days=1))


def offset_range(as_of: datetime, start: float | None = -1, end: float | None = 0, strict: bool = False) -> tuple[datetime, datetime] | None:
    """Half-open UTC range between midnights so many days from today; missing offsets are -1 and 0, in strict mode nothing."""
    if strict and not all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in (start, end)):
        return None
    today = business_day(as_of)
    return tuple(day_start(today + timedelta(days=int(x))) for x in (-1 if start is None else start, 0 if end is None else end))


def instant(at: datetime) -> Column:
    """A UTC instant as a literal that compares with timestamps with and without zone in a UTC session."""
    return F.lit(at.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def within(column: Column, bounds: tuple[datetime, datetime]) -> Column:
    return (column >= instant(bounds[0])) & (column < instant(bounds[1]))


def local_date(column: Column) -> Column:
    """The zone's day of a UTC timestamp."""
    return (column + F.expr("INTERVAL 9 HOURS")).cast("date")


def local_text(column: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(column + F.expr("INTERVAL 9 HOURS"), pattern)


def local_text_of(text: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """The same for a stored text; what is no timestamp stays as it is."""
    return F.coalesce(local_text(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), pattern), text)


def parse_stamp(text: str) -> datetime:
    """A stored timestamp, strictly in the form 2024-01-31 23:59:59."""
    if not re.fullmatch(r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d", text):
        raise ValueError(f"not a timestamp: {text!r}")
    return datetime.strptime(text, _STAMP)


#: Spans of time that a history query may name, in hours.
SINCE_HOURS = {"1h": 1, "2h": 2, "3h": 3, "6h": 6, "12h": 12, "1d": 24, "2d": 48, "7d": 168}
OTHER_SINCE_HOURS = 10


def since(as_of: datetime, span: str) -> datetime | None:
    """The start of a named span before an instant; an unknown name means ten hours, an empty one no limit."""
    return as_of - timedelta(hours=SINCE_HOURS.get(span, OTHER_SINCE_HOURS)) if span else None


def fill_date(pattern: str, day: date) -> str:
    """Year, month and day in a name: in braces first, then bare, in capitals or small letters."""
    values = (("YYYY", f"{day.year:04d}"), ("MM", f"{day.month:02d}"), ("DD", f"{day.day:02d}"))
    for name, value in values:
        pattern = pattern.replace("{" + name + "}", value).replace("{" + name.lower() + "}", value)
    for name, value in values:
        pattern = pattern.replace(name, value).replace(name.lower(), value)
    return pattern
