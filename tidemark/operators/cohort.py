"""Cohort chain: first stay, code-version filter, titles, profile, one row per subject.

P1 ``first_stay``            earliest ``intime`` per subject (NULL times last, ties by stay_id)
P2 ``icd9_only_diagnoses``   subjects whose every diagnosis is version 9, with the
                             version-9 diagnoses of their first-stay admission
P3 ``titled_diagnoses``      + the code title (inner: untitled codes drop)
P4 ``stay_profile``          + age of the admission and demographics of the stay
P5 ``unique_profile``        one row per subject

Top-1 per subject is a ``row_number`` filter: Catalyst inserts a partial
``WindowGroupLimit`` before the shuffle, so a subject with a huge number of rows
is cut to one row per map task before it is exchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import OUTPUTS, STAY_COLUMNS


def top1_per_key(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row per ``key``: the first by ``order`` (row_number with a partial WindowGroupLimit)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def first_stay(icustays: DataFrame) -> DataFrame:
    """The first ICU stay of each subject."""
    ranked = top1_per_key(icustays.select(*STAY_COLUMNS), ["subject_id"],
                          [F.asc_nulls_last("intime"), F.asc_nulls_last("stay_id")])
    return ranked.select(*OUTPUTS["first_icu_stay"])


def single_version_subjects(diagnoses: DataFrame, version: int = 9) -> DataFrame:
    """Subjects whose highest code version over all admissions is ``version``
    (GROUP BY ... HAVING max = version; partial aggregation map-side)."""
    return (diagnoses.groupBy("subject_id").agg(F.max("icd_version").alias("_maxv"))
            .filter(F.col("_maxv") == version).select("subject_id"))


def icd9_only_diagnoses(first: DataFrame, diagnoses: DataFrame, version: int = 9) -> DataFrame:
    """First stays of single-version subjects x their version-``version``
    diagnoses of the same admission."""
    cohort = first.join(single_version_subjects(diagnoses, version), "subject_id", "left_semi")
    dx = (diagnoses.filter(F.col("icd_version") == version)
          .select("subject_id", "hadm_id", "seq_num", "icd_code", "icd_version"))
    return cohort.join(dx, ["subject_id", "hadm_id"]).select(*OUTPUTS["fis_icd9"])


def titled_diagnoses(fis: DataFrame, titles: DataFrame) -> DataFrame:
    """Attach ``long_title`` on (code, version); untitled codes drop."""
    t = titles.select("icd_code", "icd_version", "long_title")
    return fis.join(t, ["icd_code", "icd_version"]).select(*OUTPUTS["fis_icd9_titled"])


#: The stay's times that a profile may carry, so that the stay window needs no join of its own.
STAY_TIMES = ["icu_intime", "icu_outtime"]


def stay_profile(titled: DataFrame, age: DataFrame, detail: DataFrame, carry: list[str] = ()) -> DataFrame:
    """Demographics: age of the admission, gender/race of the stay; ``carry``: more columns of the stay."""
    a = age.select("subject_id", "hadm_id", "anchor_age")
    d = detail.select("stay_id", "gender", "race", *carry)
    return (titled.join(a, ["subject_id", "hadm_id"]).join(d, "stay_id")
            .select(*OUTPUTS["fisi9t_profile"], *carry))


def unique_profile(profile: DataFrame, carry: list[str] = ()) -> DataFrame:
    """P5: one row per subject.  The kept columns depend on the subject alone
    (one first stay, one age per admission, one detail per stay); a fixed order
    makes the pick deterministic even if they did not."""
    cols = OUTPUTS["fisi9t_unique_patient_profile"]
    order = [F.asc_nulls_last(c) for c in ("stay_id", "hadm_id", "seq_num", "icd_code")]
    return top1_per_key(profile, ["subject_id"], order).select(*cols, *carry)


def timed_profile(t, titled: DataFrame) -> DataFrame:
    """P5 with the stay's times, one relation for the profile and its stay windows."""
    return unique_profile(stay_profile(titled, t.age, t.icustay_detail, STAY_TIMES), STAY_TIMES)


def cohort_chain(t) -> dict[str, DataFrame]:
    """P1-P5 over a ``ClinicalTables``; returns every stage by output name."""
    first = first_stay(t.icustays)
    fis = icd9_only_diagnoses(first, t.diagnoses_icd)
    titled = titled_diagnoses(fis, t.d_icd_diagnoses)
    prof = stay_profile(titled, t.age, t.icustay_detail)
    return {"first_icu_stay": first, "fis_icd9": fis, "fis_icd9_titled": titled,
            "fisi9t_profile": prof, "fisi9t_unique_patient_profile": unique_profile(prof)}
