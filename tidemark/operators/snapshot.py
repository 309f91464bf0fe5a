"""Read-side snapshots of the hourly tables.

The reference serves one patient or one clock tick per request.  Here each
operator is set-based: the timeline and procedure log cover every selected stay
at once (a single stay is a filter that reaches the scan), the hourly delta
shares one admitted-stays relation through semi joins (no id list pulled to the
driver), and the census computes all 24 clock ticks in one job.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.json import JSON_OPTIONS, json_fields, json_object
from ..functions.time import display_clock, hour_label, on_month_day
from .paging import key_page
from .selection import TRIPLE, admitted_as_of

PAGE_SIZE = 25
CLOCK_HOURS = 24

TIMELINE_COLUMNS = ["charttime_hour", "heart_rate", "sbp", "dbp", "mbp", "resp_rate",
                    "temperature", "spo2", "glucose"]
PROCEDURE_LOG_COLUMNS = ["charttime_hour", "charttime", "item_label", "value", "valueuom",
                         "ordercategoryname", "statusdescription"]
NEW_PATIENT_COLUMNS = ["subject_id", "stay_id", "hadm_id", "anchor_age", "gender", "race",
                       "first_careunit", "intime", "outtime", "los"]
DELTA_VITAL_COLUMNS = ["subject_id", "stay_id", "charttime_hour", "heart_rate", "sbp", "dbp", "mbp",
                       "sbp_ni", "dbp_ni", "mbp_ni", "resp_rate", "temperature", "temperature_site",
                       "spo2", "glucose"]
DELTA_PROCEDURE_COLUMNS = ["subject_id", "stay_id", "charttime_hour", "charttime", "itemid",
                           "item_label", "item_unitname", "value", "valueuom", "location",
                           "locationcategory", "ordercategoryname", "ordercategorydescription",
                           "statusdescription", "originalamount", "originalrate"]


# --- P12 list page --------------------------------------------------------------

def resolve_page(requested, total: int, page_size: int = PAGE_SIZE) -> tuple[int, int]:
    """(page, number of pages): a non-integer page gives page 1, a page out of
    range gives the last page; an empty list still has one (empty) page."""
    pages = max(1, math.ceil(total / page_size))
    try:
        p = int(requested)
    except (TypeError, ValueError):
        return 1, pages
    return (p if 1 <= p <= pages else pages), pages


def patient_page(admitted: DataFrame, requested_page, page_size: int = PAGE_SIZE) -> DataFrame:
    """One page of the admitted list ordered by subject_id, with the page number,
    page count and total, from one plan (``paging.key_page``): ranks by range counts, never a
    global sort, and no count before the plan runs."""
    return key_page(admitted, "subject_id", requested_page, page_size).withColumnRenamed("total", "total_patients")


# --- P13 lookup -----------------------------------------------------------------

def patient_lookup(profile: DataFrame, requests: DataFrame) -> DataFrame:
    """Point lookups by (subject, stay, admission) for a relation of requests.
    Each request yields its profile row and ``found``; ``found = false`` is the
    not-found answer.  A single lookup is a one-row request relation."""
    req = requests.select(*TRIPLE).distinct()
    hit = profile.withColumn("found", F.lit(True))
    return (req.join(hit, TRIPLE, "left")
            .withColumn("found", F.coalesce(F.col("found"), F.lit(False))))


def lookup_one(profile: DataFrame, subject_id: int, stay_id: int, hadm_id: int) -> DataFrame:
    """Exactly-one lookup of a single triple; raises ``LookupError`` when absent."""
    row = profile.filter((F.col("subject_id") == subject_id) & (F.col("stay_id") == stay_id)
                         & (F.col("hadm_id") == hadm_id))
    if row.isEmpty():
        raise LookupError(f"no patient ({subject_id}, {stay_id}, {hadm_id})")
    return row


# --- P14, P15 detail page ---------------------------------------------------------

def for_stay(table: DataFrame, subject_id: int, stay_id: int) -> DataFrame:
    """One patient's rows: equality filters that reach the Parquet scan, where
    the (stay_id, charttime_hour) sort of the stored tables lets min/max
    statistics skip row groups."""
    return table.filter((F.col("stay_id") == stay_id) & (F.col("subject_id") == subject_id))


def _clock_rows(df: DataFrame, month: int, day: int, hour: int, upto: bool) -> DataFrame:
    if hour < 0:
        return df.filter(F.lit(False))
    if "chart_month" in df.columns and "chart_day" in df.columns:
        # stored calendar partitions: the same test, pruned at directory level
        df = df.filter((F.col("chart_month") == month) & (F.col("chart_day") == day))
    h = F.hour("charttime_hour")
    return df.filter(on_month_day("charttime_hour", month, day) & ((h <= hour) if upto else (h == hour)))


def _of_stays(table: DataFrame, stays: DataFrame | None) -> DataFrame:
    """The rows of the selected stays; None: the table's stays are the selected ones."""
    if stays is None:
        return table
    return table.join(stays.select("subject_id", "stay_id"), ["subject_id", "stay_id"], "left_semi")


def vitals_timeline(vitals_hourly: DataFrame, stays: DataFrame | None, month: int, day: int,
                    hour: int, ordered: bool = False) -> DataFrame:
    """Hourly vitals of the selected stays (None: of all) up to the clock hour, with the
    ``HH:00`` label (grid rows without readings included, as in the table).
    ``ordered`` sorts by (stay, hour) -- a range-partitioned distributed sort."""
    v = _of_stays(_clock_rows(vitals_hourly, month, day, hour, upto=True), stays)
    out = v.select("subject_id", "stay_id", *TIMELINE_COLUMNS,
                   hour_label("charttime_hour").alias("hour_label"))
    return out.orderBy("stay_id", "charttime_hour") if ordered else out


def vitals_timeline_json(timeline: DataFrame) -> DataFrame:
    """P14 encoded: one JSON object per timeline row, NULL keys kept, times as
    ISO text.  Rows of a stay in ``charttime_hour`` order concatenate to the
    page's JSON array; nothing is collected into one row."""
    return timeline.select("subject_id", "stay_id", "charttime_hour",
                           json_object(timeline, TIMELINE_COLUMNS + ["hour_label"]).alias("json"))


def vitals_timeline_arrays(timeline: DataFrame) -> DataFrame:
    """P14 as the page embeds it: one JSON array per stay, ordered by hour.

    A group here is one stay's timeline rows, which the clock filter already
    bounds to 24 per calendar day the stay covers (a month and day of one
    year), so collecting it into one row is bounded by construction.  The
    per-row form above needs no collection at all.
    """
    row = json_fields(timeline, TIMELINE_COLUMNS + ["hour_label"])
    arr = F.array_sort(F.collect_list(row))  # struct order: charttime_hour first
    return (timeline.groupBy("subject_id", "stay_id")
            .agg(F.to_json(arr, JSON_OPTIONS).alias("json"), F.count(F.lit(1)).alias("n_hours")))


def procedure_log(procedures_hourly: DataFrame, stays: DataFrame | None, month: int, day: int,
                  hour: int, ordered: bool = False) -> DataFrame:
    """Procedure rows of the selected stays (None: of all) up to the clock hour and the
    stay's row count (empty grid hours count, as in the table).  The count is a window over the stay's
    rows of that day, so the table is read once; a window's rows spill.  ``ordered``
    sorts by (stay, hour, event time)."""
    p = _of_stays(_clock_rows(procedures_hourly, month, day, hour, upto=True), stays)
    count = F.count(F.lit(1)).over(Window.partitionBy("subject_id", "stay_id"))
    out = p.select("subject_id", "stay_id", *PROCEDURE_LOG_COLUMNS, count.alias("procedures_count"))
    return out.orderBy("stay_id", "charttime_hour", F.asc_nulls_last("charttime")) if ordered else out


# --- P16 hourly delta ------------------------------------------------------------

def delta_new_patients(on_day: DataFrame, hour: int) -> DataFrame:
    """Patients of the clock day admitted at exactly ``hour``."""
    return on_day.filter(F.hour("intime") == hour).select(*NEW_PATIENT_COLUMNS)


def _of_admitted(table: DataFrame, on_day: DataFrame | None, hour: int) -> DataFrame:
    if on_day is None:
        return table
    return table.join(admitted_as_of(on_day, hour).select("stay_id"), "stay_id", "left_semi")


def delta_vitals(vitals_hourly: DataFrame, on_day: DataFrame | None, month: int, day: int,
                 hour: int) -> DataFrame:
    """Vitals at exactly the clock hour for every admitted stay (matched on stay_id); ``on_day`` None:
    the table's stays are the admitted ones."""
    v = _clock_rows(vitals_hourly, month, day, hour, upto=False)
    return _of_admitted(v, on_day, hour).select(*DELTA_VITAL_COLUMNS)


def delta_procedures(procedures_hourly: DataFrame, on_day: DataFrame | None, month: int, day: int,
                     hour: int) -> DataFrame:
    """Procedure rows at exactly the clock hour for every admitted stay."""
    p = _clock_rows(procedures_hourly, month, day, hour, upto=False)
    return _of_admitted(p, on_day, hour).select(*DELTA_PROCEDURE_COLUMNS)


def admitted_at_ticks(patients: DataFrame, ticks: DataFrame) -> DataFrame:
    """(tick_month, tick_day, tick_hour) of ``ticks`` with the stay_id of every patient admitted on the tick's
    day, in any year, by its hour.  Ticks before the clock starts (hour < 0) admit nobody."""
    admitted = patients.select("stay_id", F.month("intime").alias("tick_month"), F.dayofmonth("intime").alias("tick_day"),
                               F.hour("intime").alias("admit_hour"))
    return ticks.where("tick_hour >= 0").join(admitted, ["tick_month", "tick_day"]).where("admit_hour <= tick_hour") \
        .select("tick_month", "tick_day", "tick_hour", "stay_id")


def delta_vitals_at_ticks(vitals_hourly: DataFrame, patients: DataFrame, ticks: DataFrame) -> DataFrame:
    """P16 for a relation of clock ticks (tick_month, tick_day, tick_hour): the vitals at each tick of the stays that it
    admits, all ticks in one query.

    ``vitals_hourly`` is a stored table in calendar directories (chart_month, chart_day): both are join keys, so the
    days that the admitted stays have prune directories at run time, and the stay joins its own hours."""
    admitted = admitted_at_ticks(patients, ticks)
    same = (F.col("v.stay_id") == F.col("a.stay_id")) & (F.col("v.chart_month") == F.col("a.tick_month")) \
        & (F.col("v.chart_day") == F.col("a.tick_day")) & (F.hour("v.charttime_hour") == F.col("a.tick_hour"))
    return vitals_hourly.alias("v").join(admitted.alias("a"), same) \
        .select("tick_month", "tick_day", "tick_hour", *[F.col(f"v.{c}").alias(c) for c in DELTA_VITAL_COLUMNS])


# --- the clock's response ----------------------------------------------------------

def clock_response(on_day: DataFrame, vitals: DataFrame, procedures: DataFrame, hour: int, current_time: Column) -> DataFrame:
    """P16 as a document (K4): (section, member, json) rows, one JSON object each.

    The section ``response`` has one row: the clock, its text and the counts.  The other sections hold the members of the
    document's lists, one per row, so no list is collected into a row; ``member`` tells them apart.  ``vitals`` and
    ``procedures`` are the rows of ``delta_vitals`` and ``delta_procedures``.  All counts come from one aggregation."""
    new, admitted = delta_new_patients(on_day, hour), admitted_as_of(on_day, hour)

    def part(section: str, rows: DataFrame, key: list[Column], columns: list[str]) -> DataFrame:
        return rows.select(F.lit(section).alias("section"), F.concat_ws("/", *key).alias("member"), json_object(rows, columns).alias("json"))

    hour_text = F.date_format("charttime_hour", "yyyy-MM-dd HH:mm:ss")
    lists = [part("new_patients", new, [F.col("stay_id").cast("string")], NEW_PATIENT_COLUMNS),
             part("vitalsigns", vitals, [F.col("stay_id").cast("string"), hour_text], DELTA_VITAL_COLUMNS),
             part("procedureevents", procedures, [F.col("stay_id").cast("string"), hour_text], DELTA_PROCEDURE_COLUMNS)]
    members = lists[0].unionByName(lists[1]).unionByName(lists[2])
    tally = members.select("section").unionByName(admitted.select(F.lit("admitted").alias("section")))
    count = lambda section: F.count_if(F.col("section") == section)
    counts = tally.agg(count("new_patients").alias("new_patients_count"), count("admitted").alias("total_admitted"),
                       count("vitalsigns").alias("vitalsigns_count"), count("procedureevents").alias("procedureevents_count"))
    head = counts.select(F.lit(hour).alias("current_hour"), current_time.alias("current_time"), "*")
    head = head.select(F.lit("response").alias("section"), F.lit("").alias("member"), json_object(head, head.columns).alias("json"))
    return head.unionByName(members)


# --- P17 census --------------------------------------------------------------------

def _admitted_rows_by_hour(table: DataFrame, on_day: DataFrame, month: int, day: int) -> DataFrame:
    """Rows of an hourly table on the clock day whose stay was admitted by the
    row's hour, counted per hour (equi join on stay + residual hour test)."""
    on_day_rows = table
    if "chart_month" in table.columns and "chart_day" in table.columns:
        on_day_rows = table.filter((F.col("chart_month") == month) & (F.col("chart_day") == day))
    rows = on_day_rows.filter(on_month_day("charttime_hour", month, day)) \
                      .select("stay_id", F.hour("charttime_hour").alias("hour"))
    adm = on_day.select("stay_id", F.hour("intime").alias("admit_hour"))
    return (rows.join(adm, "stay_id").filter(F.col("admit_hour") <= F.col("hour"))
            .groupBy("hour").agg(F.count(F.lit(1)).alias("n")))


def hourly_census(spark: SparkSession, on_day: DataFrame, vitals_hourly: DataFrame,
                  procedures_hourly: DataFrame, month: int, day: int,
                  display_date: str | None = None) -> DataFrame:
    """All 24 clock ticks at once: the tick's display time, new patients at the
    hour, patients admitted by the hour (running sum), and the vitals / procedure
    rows a tick returns.  Of the two tables only (stay_id, charttime_hour) of every row count, so relations
    with these columns and as many rows do (vitals: the grid).  ``display_date`` (``yyyy-MM-dd``) is the day the clock
    text shows; by default the clock day in year 2025."""
    display_date = display_date or f"2025-{month:02d}-{day:02d}"
    hours = spark.range(CLOCK_HOURS).select(F.col("id").cast("int").alias("hour"))
    new = on_day.groupBy(F.hour("intime").alias("hour")).agg(F.count(F.lit(1)).alias("new_patients"))
    vit = _admitted_rows_by_hour(vitals_hourly, on_day, month, day).withColumnRenamed("n", "vitalsigns_count")
    proc = _admitted_rows_by_hour(procedures_hourly, on_day, month, day) \
        .withColumnRenamed("n", "procedureevents_count")
    # Each per-hour aggregate is keyed by hour of day: at most 24 rows whatever the
    # data, a proven bound, so they are broadcast; the running total is a window
    # over the 24-row table only.
    running = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    out = (hours.join(F.broadcast(new), "hour", "left").join(F.broadcast(vit), "hour", "left")
           .join(F.broadcast(proc), "hour", "left")
           .fillna(0, ["new_patients", "vitalsigns_count", "procedureevents_count"]))
    return out.select("hour", display_clock(F.col("hour"), F.lit(display_date)).alias("current_time"),
                      "new_patients",
                      F.sum("new_patients").over(running).alias("total_admitted"),
                      "vitalsigns_count", "procedureevents_count")
