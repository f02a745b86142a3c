"""Time functions (F11-F17). All work on ``timestamp_ntz`` without any zone conversion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_to_ts(c) -> Column:
    """Unix epoch seconds -> timestamp_ntz holding the UTC wall clock, independent of the
    session zone (the reference used the machine's zone). Whole days plus the remaining seconds
    are added to 1970-01-01 as intervals."""
    x = _c(c).cast("long")
    days = F.floor(x / 86400)
    secs = (x - days * 86400).cast("int")
    return (F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
            + F.make_dt_interval(days=days.cast("int"), secs=secs))


def day_start(c) -> Column:
    """F15 (normalize): midnight of the day, timestamp_ntz."""
    return F.to_date(_c(c)).cast("timestamp_ntz")


def floor_hour(c) -> Column:
    """F15 (floor to hour) on timestamp_ntz, without going through a zoned timestamp."""
    c = _c(c)
    return day_start(c) + F.make_dt_interval(hours=F.hour(c))


def add_hours(c, hours) -> Column:
    """F16: timestamp + hours (int or Column)."""
    h = hours if isinstance(hours, Column) else F.lit(int(hours))
    return _c(c) + F.make_dt_interval(hours=h)


def at_hour(date_col, hour: int) -> Column:
    """F16: the date's ``hour:00`` as timestamp_ntz (``ts.replace(hour=..)``)."""
    return add_hours(_c(date_col).cast("date").cast("timestamp_ntz"), hour)


def day_of_week(c) -> Column:
    """0 = Monday ... 6 = Sunday (pandas ``dayofweek``)."""
    return F.weekday(_c(c))


def roll_weekend(c, hour: int = 8) -> Column:
    """Saturday/Sunday timestamps move to the next Monday at ``hour``:00; others unchanged."""
    c = _c(c)
    dow = day_of_week(c)
    monday = F.date_add(F.to_date(c), F.lit(7) - dow).cast("timestamp_ntz")
    return F.when(dow >= 5, add_hours(monday, hour)).otherwise(c)


def hour_range(start, end) -> Column:
    """inclusive hourly range ``[start, end]`` as an array of timestamp_ntz."""
    return F.sequence(_c(start), _c(end), F.expr("INTERVAL 1 HOUR"))


def parse_date(c, fmt: str = "yyyy-MM-dd") -> Column:
    """parse with coercion to NULL on bad input."""
    return F.try_to_timestamp(_c(c), F.lit(fmt)).cast("date")


def format_date(c, fmt: str = "yyyy-MM-dd") -> Column:
    """format a date as text."""
    return F.date_format(_c(c), fmt)
