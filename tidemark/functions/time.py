"""Time helpers (X1-X4, X7-X9, F12, F13).  All built-in expressions, no UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Readings round half-up to the hour (30 minutes), clusters split
# on gaps strictly over 15 minutes, the grid steps one hour.
ROUND_OFFSET = "INTERVAL 30 MINUTES"
CLUSTER_GAP = "INTERVAL 15 MINUTES"
ONE_HOUR = "INTERVAL 1 HOUR"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trunc_hour(c) -> Column:
    """The start of a zone-less time's hour.  ``date_trunc`` would go through TIMESTAMP and so
    through the session's zone; the day's start plus whole hours stays zone-less, without decimals."""
    t = _c(c)
    return t.cast("date").cast("timestamp_ntz") + F.hour(t) * F.expr(ONE_HOUR)


def minutes_of(c) -> Column:
    """Whole minutes of a zone-less time since 1970 (floored), in integers."""
    t = _c(c)
    return F.unix_date(t.cast("date")).cast("long") * 1440 + F.hour(t) * 60 + F.minute(t)


def micros_of(c) -> Column:
    """Microseconds of a zone-less time since 1970, whatever the session's zone."""
    since = _c(c) - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    part = lambda field, micros: F.date_part(F.lit(field), since).cast("decimal(18,6)") * F.lit(micros)
    return (part("DAY", 86_400_000_000) + part("HOUR", 3_600_000_000) + part("MINUTE", 60_000_000)
            + part("SECOND", 1_000_000)).cast("long")


def round_to_hour(c) -> Column:
    """Nearest hour, half-up: :30:00 goes up, :29:59 goes down."""
    return trunc_hour(_c(c) + F.expr(ROUND_OFFSET))


def plus_hours(c, n: int = 1) -> Column:
    return _c(c) + F.make_dt_interval(F.lit(0), F.lit(n))


def on_month_day(c, month: int, day: int) -> Column:
    """Calendar month/day equality in any year."""
    return (F.month(_c(c)) == month) & (F.dayofmonth(_c(c)) == day)


def hour_of(c) -> Column:
    return F.hour(_c(c))


def hour_label(c) -> Column:
    """``HH:00`` label of a time's hour."""
    return F.format_string("%02d:00", F.hour(_c(c)))


def display_clock(hour: Column, base_date: Column) -> Column:
    """Clock text shown for a simulation hour: hour + 1, floored at midnight of the
    base day and capped at midnight of the next day."""
    shown = F.least(F.greatest(hour + 1, F.lit(0)), F.lit(24))
    t = base_date.cast("date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), shown)
    return F.date_format(t, "MMMM d, yyyy HH:mm")
