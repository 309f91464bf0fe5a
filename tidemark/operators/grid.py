"""Stay windows and the dense hourly grid.

The grid of a stay runs from the hour of admission to the hour of discharge plus
one, inclusive, one row per hour.  It is an ``explode(sequence(...))``: a narrow
operator, no shuffle, and its size per stay is bounded by the stay's length.
A NULL or reversed window yields no rows (``sequence`` would raise on a
reversed range, so it is guarded).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import ONE_HOUR, on_month_day, plus_hours, trunc_hour


def stay_window(cohort: DataFrame, detail: DataFrame) -> DataFrame:
    """(subject_id, stay_id) of the cohort x the stay's ICU in/out times."""
    d = detail.select("stay_id", "icu_intime", "icu_outtime")
    return (cohort.select("subject_id", "stay_id").join(d, "stay_id")
            .select("subject_id", "stay_id",
                    trunc_hour("icu_intime").alias("start_hour"),
                    trunc_hour("icu_outtime").alias("end_hour"),
                    "icu_intime", "icu_outtime"))


def timed_window(profile: DataFrame) -> DataFrame:
    """``stay_window`` of a profile that carries the stay's times: a projection."""
    return profile.select("subject_id", "stay_id", trunc_hour("icu_intime").alias("start_hour"),
                          trunc_hour("icu_outtime").alias("end_hour"), "icu_intime", "icu_outtime")


def hour_grid(window: DataFrame, month: int | None = None, day: int | None = None, bounds: bool = False) -> DataFrame:
    """One row per (subject_id, stay_id, charttime_hour) of each stay window; with ``month`` and ``day`` its
    hours on that day of any year alone, cut before they become rows; with ``bounds`` the stay's times as well."""
    last = plus_hours("end_hour", 1)
    hours = F.sequence(F.col("start_hour"), last, F.expr(ONE_HOUR))
    if month is not None:
        hours = F.filter(hours, lambda h: on_month_day(h, month, day))
    hours = F.when(F.col("start_hour") <= last, hours)
    return window.select("subject_id", "stay_id", F.explode(hours).alias("charttime_hour"), *(["icu_intime", "icu_outtime"] if bounds else []))


def on_calendar_day(window: DataFrame, month: int, day: int) -> DataFrame:
    """The stay windows whose grid has hours on a calendar day of any year, tested day by day."""
    first, last = F.col("start_hour").cast("date"), plus_hours("end_hour", 1).cast("date")
    days = F.when(first <= last, F.sequence(first, last))
    return window.where(F.exists(days, lambda d: on_month_day(d, month, day)))


def cohort_stays(unique_profile: DataFrame) -> DataFrame:
    """(subject_id, stay_id) of the one-row-per-subject profile.  The profile is
    unique per subject (and a subject's first stay is one stay), so the pairs are
    already distinct: no DISTINCT aggregate, no extra shuffle."""
    return unique_profile.select("subject_id", "stay_id")
