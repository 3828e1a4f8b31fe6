"""Time parts of TIMESTAMP_NTZ columns, free of the session time zone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from parkpulse.functions import vocabulary as V

EPOCH = "1970-01-01"


def hour_floor(ts: Column) -> Column:
    """Start of the clock hour. `date_trunc` would return TIMESTAMP and use the session zone."""
    within = F.make_dt_interval(
        F.lit(0), F.lit(0), F.minute(ts), F.extract(F.lit("SECOND"), ts)
    )
    return ts - within


def seconds_into_hour(ts: Column) -> Column:
    return (F.minute(ts) * 60 + F.second(ts)).cast("bigint")


def whole_seconds(start: Column, end: Column) -> Column:
    """Seconds between two times. `timestampdiff` would convert to the session zone first."""
    days = F.date_diff(end, start).cast("bigint") * 86_400
    return days + second_of_day(end) - second_of_day(start)


def whole_hours(start: Column, end: Column) -> Column:
    return F.call_function("div", whole_seconds(start, end), F.lit(3600))


def second_of_day(ts: Column) -> Column:
    return F.hour(ts).cast("bigint") * 3600 + seconds_into_hour(ts)


def hour_number(ts: Column) -> Column:
    """Whole hours since the epoch."""
    return F.date_diff(ts, F.lit(EPOCH).cast("date")).cast("bigint") * 24 + F.hour(ts)


def hour_start(number: Column) -> Column:
    """The time at which an hour by `hour_number` begins."""
    return F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), number.cast("int"))


def inside_cycle(until: Column, cycle: int, start: Column, length: int) -> Column:
    """How much of [0, until) lies in [start, start + length) of each cycle: whole cycles, and the rest."""
    whole = F.call_function("div", until, F.lit(cycle)) * length
    rest = F.greatest(F.lit(0), F.pmod(until, F.lit(cycle)) - start)
    return whole + F.least(F.lit(length), rest)


def weekday_name(weekday: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in V.WEEKDAY_NAMES]), weekday)


def day_night(ts: Column) -> Column:
    return F.when(F.hour(ts).between(7, 18), V.DAY).otherwise(V.NIGHT)


def is_day_off(ts: Column, holidays: Sequence[str] = V.HOLIDAYS) -> Column:
    listed = F.to_date(ts).isin([F.lit(d).cast("date") for d in holidays])
    return (F.weekday(ts) >= 5) | listed


def day_type(
    ts: Column,
    holidays: Sequence[str] = V.HOLIDAYS,
    new_year: tuple[str, str] | None = V.NEW_YEAR_WINDOW,
) -> Column:
    """Lunar new year, holiday or workday; without `new_year` the two-way form.

    The new-year window ends at the first instant of its last day.
    """
    off = F.when(is_day_off(ts, holidays), V.HOLIDAY).otherwise(V.WORKDAY)
    if new_year is None:
        return off
    lo, hi = (F.lit(d).cast("timestamp_ntz") for d in new_year)
    return F.when(ts.between(lo, hi), V.LUNAR_NEW_YEAR).otherwise(off)


def calendar_bucket(ts: Column, width: str) -> Column:
    """First day of the 'day', 'month', 'half' year or 'year' that holds `ts`."""
    day = F.to_date(ts)
    if width == "day":
        return day
    if width == "half":
        first_month = F.when(F.month(day) <= 6, 1).otherwise(7)
        return F.make_date(F.year(day), first_month, F.lit(1))
    if width in ("month", "year"):
        return F.trunc(day, width)
    raise ValueError(f"unknown bucket width: {width}")


def grain(ts: Column, name: str) -> Column:
    """Grouping key for a report grain. Months of different years share a key."""
    keys = {"date": F.to_date, "hour": F.hour, "weekday": F.weekday, "month": F.month}
    if name not in keys:
        raise ValueError(f"unknown grain: {name}")
    return keys[name](ts)


def in_days(ts: Column, first: str, last: str) -> Column:
    """Inclusive day range written as a half-open timestamp range, so it pushes down."""
    lo = F.lit(first).cast("timestamp_ntz")
    hi = F.lit(last).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
    return (ts >= lo) & (ts < hi)
