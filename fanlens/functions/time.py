"""Time rules.

Event times are ``timestamp_ntz`` (wall clock, no zone).  Every truncation goes
through ``to_date`` so results do not depend on the session time zone, and
day differences count calendar-day boundaries (23:59 -> 00:01 is one day), not
elapsed 24-hour units.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def month_start(col) -> Column:
    """First instant of the calendar month, as ``timestamp_ntz``."""
    return F.trunc(F.to_date(_c(col)), "month").cast("timestamp_ntz")


GRAINS = ("day", "week", "month", "quarter", "year")


def period_start(col, grain: str = "month") -> Column:
    """First instant of the period of ``grain`` (weeks begin on Monday), as ``timestamp_ntz``."""
    if grain not in GRAINS:
        raise ValueError(f"grain {grain!r} is none of {GRAINS}")
    day = F.to_date(_c(col))
    return (day if grain == "day" else F.trunc(day, grain)).cast("timestamp_ntz")


def period_index(col, grain: str = "month") -> Column:
    """Number of the period (bigint): neighbours differ by one."""
    c = _c(col)
    if grain in ("day", "week"):
        days = F.datediff(F.to_date(period_start(c, grain)), F.lit("1970-01-05").cast("date"))  # a Monday
        return (days if grain == "day" else F.floor(days / 7)).cast("bigint")
    year = F.year(c)
    number = {"year": year, "quarter": year * 4 + F.quarter(c), "month": year * 12 + F.month(c)}[grain]
    return number.cast("bigint")


def add_periods(col, periods: int, grain: str = "month") -> Column:
    """The instant so many periods later."""
    if grain in ("day", "week"):
        return add_days(col, periods * (7 if grain == "week" else 1))
    return add_months(col, periods * {"month": 1, "quarter": 3, "year": 12}[grain])


def period_diff(start, end, grain: str = "month") -> Column:
    """Whole periods from ``start`` to ``end`` (bigint, may be negative)."""
    return period_index(end, grain) - period_index(start, grain)


def day_start(col) -> Column:
    """Midnight of the calendar day, as ``timestamp_ntz``."""
    return F.to_date(_c(col)).cast("timestamp_ntz")


def add_days(col, days: int) -> Column:
    return _c(col) + F.make_dt_interval(F.lit(days))


def add_months(col, months: int) -> Column:
    return _c(col) + F.make_ym_interval(F.lit(0), F.lit(months))


def day_diff(start, end) -> Column:
    """Number of calendar-day boundaries from ``start`` to ``end`` (bigint)."""
    return F.datediff(F.to_date(_c(end)), F.to_date(_c(start))).cast("bigint")


def month_diff(start, end) -> Column:
    """Whole calendar months from ``start`` to ``end`` (bigint, may be negative)."""
    s, e = _c(start), _c(end)
    return ((F.year(e) - F.year(s)) * 12 + (F.month(e) - F.month(s))).cast("bigint")


def year_month(col) -> Column:
    """``yyyy-MM`` label of a month."""
    return F.date_format(_c(col), "yyyy-MM")


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def utc_wallclock(instant) -> Column:
    """Zoned ``timestamp`` instant -> its UTC wall clock as ``timestamp_ntz`` (any session zone)."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(_c(instant)), _epoch())


def as_utc_instant(wallclock) -> Column:
    """``timestamp_ntz`` wall clock -> the zoned instant with that UTC wall clock.

    Event-time windows and watermarks need a zoned timestamp; going through UTC
    keeps 1-day windows aligned with calendar days whatever the session zone."""
    w = _c(wallclock)
    days = F.datediff(F.to_date(w), F.lit("1970-01-01").cast("date")).cast("bigint")
    tod = (F.hour(w) * 3600 + F.minute(w) * 60).cast("bigint") * 1_000_000 + (
        F.extract(F.lit("SECOND"), w) * 1_000_000
    ).cast("bigint")
    return F.timestamp_micros(days * 86_400_000_000 + tod)


def to_event_time(epoch_millis) -> Column:
    """Epoch milliseconds -> wall-clock ``timestamp_ntz`` in UTC."""
    return utc_wallclock(F.timestamp_millis(_c(epoch_millis)))


def epoch_millis(wallclock) -> Column:
    """UTC wall clock -> epoch milliseconds."""
    return F.unix_millis(as_utc_instant(wallclock))
