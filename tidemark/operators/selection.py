"""Cohort selection and the admission clock.

The clock filters are calendar tests on ``intime``: month and day in any year
and the hour of day.  Once admitted a patient stays admitted (no discharge
test).  A cohort is a relation, not a client-side IN list: the selection is a
semi join, so a cohort of any size stays in the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import on_month_day

TRIPLE = ["subject_id", "stay_id", "hadm_id"]


def cohort_relation(spark: SparkSession, triples: Sequence[tuple[int, int, int]] | None = None,
                    subject_ids: Sequence[int] | None = None) -> tuple[str, DataFrame] | None:
    """A literal cohort list (S14) as a relation.  Precedence: triples, else
    subject ids, else no filter (an empty list counts as unset)."""
    if triples:
        schema = T.StructType([T.StructField(c, T.LongType(), False) for c in TRIPLE])
        return "triples", spark.createDataFrame([tuple(r) for r in triples], schema)
    if subject_ids:
        schema = T.StructType([T.StructField("subject_id", T.LongType(), False)])
        return "subject_ids", spark.createDataFrame([(int(s),) for s in subject_ids], schema)
    return None


def select_cohort(profile: DataFrame, triples: DataFrame | None = None,
                  subject_ids: DataFrame | None = None) -> DataFrame:
    """P10 cohort part: keep profiles matching the cohort (triples take precedence).
    A semi join ignores duplicate cohort rows, so the lists are not de-duplicated."""
    if triples is not None:
        return profile.join(triples.select(*TRIPLE), TRIPLE, "left_semi")
    if subject_ids is not None:
        return profile.join(subject_ids.select("subject_id"), "subject_id", "left_semi")
    return profile


def base_patients(profile: DataFrame, cohort: tuple[str, DataFrame] | None, month: int, day: int) -> DataFrame:
    """The query set behind every list, delta and count: the cohort (a relation of
    ``cohort_relation``; None keeps everyone), then the clock's month and day."""
    kind, relation = cohort or ("", None)
    rows = select_cohort(profile, triples=relation if kind == "triples" else None,
                         subject_ids=relation if kind == "subject_ids" else None)
    return admitted_on(rows, month, day)


def admitted_on(patients: DataFrame, month: int, day: int) -> DataFrame:
    """P10 date part: admitted on ``month``/``day`` of any year."""
    return patients.filter(on_month_day("intime", month, day))


def admitted_as_of(patients_on_day: DataFrame, hour: int) -> DataFrame:
    """Admitted at or before ``hour``; nobody before the clock starts (hour < 0)."""
    return patients_on_day.filter(is_admitted(hour))


def is_admitted(hour: int) -> Column:
    """Whether a patient of the clock day counts as admitted at the clock's ``hour``."""
    return F.hour("intime") <= hour if hour >= 0 else F.lit(False)


def clock_state(patients_on_day: DataFrame, hour: int) -> DataFrame:
    """One row: the patients of the clock day, and those admitted at ``hour`` (none before the clock starts)."""
    return patients_on_day.agg(F.count(F.lit(1)).alias("n_on_day"), F.count_if(is_admitted(hour)).alias("n_admitted"))


def admitted_at(patients_on_day: DataFrame, hour: int) -> DataFrame:
    """Admitted exactly at ``hour`` (the new patients of a clock tick)."""
    return patients_on_day.filter(F.hour("intime") == hour)
