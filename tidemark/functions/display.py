"""Display projections of the list and detail pages.

Template rules re-expressed as column expressions:

* a missing value shows as ``-``; empty text and a zero number count as missing;
* gender ``M``/``F`` reads ``Male``/``Female``, anything else as is (or ``-``);
* text over 20 characters is cut to 19 and an ellipsis;
* times read ``Mon DD, YYYY HH:MM`` (list and header) or ``HH:MM`` (log).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the page templates.
MISSING = "-"
ELLIPSIS = "…"
TRUNCATE_AT = 20
DATETIME_FORMAT = "MMM dd, yyyy HH:mm"
TIME_FORMAT = "HH:mm"
GENDER_LABELS = {"M": "Male", "F": "Female"}
SEPARATOR = " · "


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _falsy(c: Column, numeric: bool) -> Column:
    return c.isNull() | ((c == 0) if numeric else (c == ""))


def or_missing(c, numeric: bool = False) -> Column:
    c = _c(c)
    return F.when(_falsy(c, numeric), F.lit(MISSING)).otherwise(c.cast("string"))


def gender_label(c) -> Column:
    c = _c(c)
    e = or_missing(c)
    for code, label in GENDER_LABELS.items():
        e = F.when(c == code, F.lit(label)).otherwise(e)
    return e


def truncate_chars(c, n: int = TRUNCATE_AT) -> Column:
    c = _c(c)
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit(ELLIPSIS))).otherwise(c)


def datetime_text(c, fmt: str = DATETIME_FORMAT) -> Column:
    return F.coalesce(F.date_format(_c(c), fmt), F.lit(MISSING))


def composite_key() -> Column:
    """The true key of a profile row, (subject_id, stay_id, hadm_id), as one value."""
    return F.struct("subject_id", "stay_id", "hadm_id")


# Row label formats of the three read models.
PATIENT_LABEL = "Patient %d - Stay %d"
VITALS_LABEL = "Vitals for %d at %s"
PROCEDURE_LABEL = "Procedure for %d - %s"


def row_label(kind: str = "patient") -> Column:
    """Row label text of a profile, vitals-hour or procedure row (X11)."""
    if kind == "patient":
        return F.format_string(PATIENT_LABEL, F.col("subject_id"), F.col("stay_id"))
    if kind == "vitals":
        return F.format_string(VITALS_LABEL, F.col("subject_id"),
                               F.date_format("charttime_hour", "yyyy-MM-dd HH:mm:ss"))
    if kind == "procedure":
        return F.format_string(PROCEDURE_LABEL, F.col("subject_id"),
                               F.coalesce(F.col("item_label"), F.lit("None")))
    raise ValueError(kind)


def _shown(patients: DataFrame, race: Column) -> DataFrame:
    return patients.select(
        "subject_id", "stay_id", "hadm_id", row_label().alias("label"),
        or_missing("anchor_age", numeric=True).alias("age_text"),
        gender_label("gender").alias("gender_text"), race.alias("race_text"),
        or_missing("first_careunit").alias("careunit_text"),
        datetime_text("intime").alias("admitted_text"))


def patient_rows(patients: DataFrame) -> DataFrame:
    """Rows as the patient list shows them."""
    return _shown(patients, truncate_chars(or_missing("race")))


def detail_header(patients: DataFrame) -> DataFrame:
    """The header of the detail page: as a list row, with the race in full."""
    return _shown(patients, or_missing("race"))


def vital_labels(hourly: DataFrame) -> DataFrame:
    """The name of each hourly vitals row."""
    return hourly.select("subject_id", "stay_id", "charttime_hour", row_label("vitals").alias("label"))


def procedure_labels(hourly: DataFrame) -> DataFrame:
    """The name of each row of the procedure table."""
    return hourly.select("subject_id", "stay_id", "charttime_hour", "orderid", row_label("procedure").alias("label"))


def plain_number(c) -> Column:
    """A number without an exponent: 12345678.0, 0.0005."""
    return F.regexp_replace(_c(c).cast("decimal(38,12)").cast("string"), r"(\.\d+?)0+$", "$1")


def procedure_rows(log: DataFrame) -> DataFrame:
    """Procedure log entries as the detail page shows them: label, time, value
    line only when a value is set, category line (with status) only when a
    category is set."""
    value = F.col("value")
    value_text = F.when(~_falsy(value, True),
                        F.concat(F.lit("Value: "), plain_number(value), F.lit(" "),
                                 F.coalesce(F.col("valueuom"), F.lit(""))))
    cat, status = F.col("ordercategoryname"), F.col("statusdescription")
    category_text = F.when(~_falsy(cat, False),
                           F.when(~_falsy(status, False), F.concat(cat, F.lit(SEPARATOR), status))
                           .otherwise(cat))
    return log.select("subject_id", "stay_id", "charttime_hour", "charttime",
                      or_missing("item_label").alias("label_text"),
                      datetime_text("charttime_hour", TIME_FORMAT).alias("time_text"),
                      value_text.alias("value_text"), category_text.alias("category_text"))
