"""Column functions on dates, sessions and slots. Timestamps are UTC; local time has a fixed offset of -3 hours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local(ts: Column) -> Column:
    return ts - F.expr("INTERVAL 3 HOURS")


def to_utc(ts: Column) -> Column:
    return ts + F.expr("INTERVAL 3 HOURS")


def previous_business_day(d: Column) -> Column:
    """The last Monday to Friday strictly before d."""
    return F.date_sub(d, F.when(F.weekday(d) == 0, 3).when(F.weekday(d) == 6, 2).otherwise(1))


def back_to_friday(d: Column) -> Column:
    """d itself, or of a weekend the Friday before."""
    return F.date_sub(d, F.greatest(F.weekday(d) - 4, F.lit(0)))


def iso_week(ts: Column) -> Column:
    """2024-w05: ISO year and week."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-w"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def month_index(d: Column) -> Column:
    return F.year(d) * 12 + F.month(d) - 1


def minus_months(d: Column, n: int) -> Column:
    """n months earlier; a day that the month lacks runs over into the next (31 March less one month: 2 or 3 March)."""
    first = F.add_months(F.trunc(d, "month"), -n)
    return F.date_add(first, F.dayofmonth(d) - 1)


def month_end_plus(d: Column, n: int) -> Column:
    return F.last_day(F.add_months(d, n))


def slot_start(ts: Column, first: int = 7, last: int = 20) -> Column:
    """Start, in local time, of the hour from `first` to `last`, or of the night from `last` to `first`."""
    at = local(ts)
    day = F.date_trunc("day", at)
    hour = F.hour(at)
    night = day + F.make_interval(hours=F.lit(last))
    return F.when(hour < first, night - F.expr("INTERVAL 1 DAY")).when(hour >= last, night).otherwise(F.date_trunc("hour", at))


def effective(published: Column, found: Column) -> Column:
    """published, but found if that is missing, over an hour after found or over eight days before it."""
    odd = (published > found + F.expr("INTERVAL 1 HOUR")) | (published < found - F.expr("INTERVAL 8 DAYS"))
    return F.when(odd, found).otherwise(F.coalesce(published, found))


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970; a timestamp without zone is taken as UTC (the session's zone)."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def last_mark(ts: Column, unit: str, minutes: int) -> Column:
    """The last time at `minutes` after the start of a day or week that has passed."""
    def mark(at: Column) -> Column:
        return F.date_trunc(unit, at).cast("timestamp_ntz") + F.make_dt_interval(mins=F.lit(minutes))

    before = ts - F.expr(f"INTERVAL {1 if unit == 'day' else 7} DAYS")
    return F.when(ts >= mark(ts), mark(ts)).otherwise(mark(before))
