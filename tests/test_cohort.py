"""Cohort chain rules (FIXTURES.md M14-M17) and the uniqueness constraint."""

from __future__ import annotations

from tidemark.operators import cohort as C
from tidemark.operators.quality import assert_unique, uniqueness_report
from clinical_cases import tables, ts


def stay(subject, hadm, stay_id, intime):
    return {"subject_id": subject, "hadm_id": hadm, "stay_id": stay_id, "intime": ts(intime),
            "outtime": ts("2130-04-01 00:00:00"), "first_careunit": "MICU"}


def dx(subject, hadm, seq, code, version=9):
    return {"subject_id": subject, "hadm_id": hadm, "seq_num": seq, "icd_code": code, "icd_version": version}


def build(spark, **rows):
    base = {
        "d_icd_diagnoses": [{"icd_code": "1", "icd_version": 9, "long_title": "A"},
                            {"icd_code": "2", "icd_version": 9, "long_title": "B"}],
    }
    base.update(rows)
    t = tables(spark, **base)
    return C.cohort_chain(t)


def test_first_stay_nulls_last_and_ties_by_stay(spark):  # rule 1, M17
    t = tables(spark, icustays=[stay(1, 10, 102, "2130-03-13 10:00:00"), stay(1, 10, 101, "2130-03-13 10:00:00"),
                                {**stay(1, 11, 100, "2130-01-01 00:00:00"), "intime": None},
                                stay(2, 20, 200, "2130-03-14 10:00:00")])
    got = {r.subject_id: r.stay_id for r in C.first_stay(t.icustays).collect()}
    assert got == {1: 101, 2: 200}


def test_icd10_anywhere_excludes_subject(spark):  # M14
    out = build(spark,
                icustays=[stay(1, 10, 100, "2130-03-13 10:00:00"), stay(2, 20, 200, "2130-03-13 10:00:00")],
                diagnoses_icd=[dx(1, 10, 1, "1"), dx(1, 11, 1, "9", 10), dx(2, 20, 1, "1")])
    assert {r.subject_id for r in out["fis_icd9"].collect()} == {2}


def test_other_admissions_and_untitled_codes_drop(spark):  # M15, M16
    out = build(spark,
                icustays=[stay(1, 10, 100, "2130-03-13 10:00:00"), stay(1, 11, 101, "2130-03-20 10:00:00"),
                          stay(2, 20, 200, "2130-03-13 10:00:00")],
                diagnoses_icd=[dx(1, 10, 1, "1"), dx(1, 11, 1, "2"), dx(2, 20, 1, "77")],
                age=[{"subject_id": 1, "hadm_id": 10, "anchor_age": 70}],
                icustay_detail=[{"stay_id": 100, "gender": "F", "race": "X"}])
    assert [(r.hadm_id, r.icd_code) for r in out["fis_icd9"].orderBy("subject_id").collect()] == \
        [(10, "1"), (20, "77")]
    assert [r.subject_id for r in out["fis_icd9_titled"].collect()] == [1]
    prof = out["fisi9t_unique_patient_profile"].collect()
    assert [(r.subject_id, r.stay_id, r.anchor_age, r.gender) for r in prof] == [(1, 100, 70, "F")]


def test_unique_profile_one_row_per_subject(spark):  # P5, P20
    out = build(spark,
                icustays=[stay(1, 10, 100, "2130-03-13 10:00:00")],
                diagnoses_icd=[dx(1, 10, 1, "1"), dx(1, 10, 2, "2")],
                age=[{"subject_id": 1, "hadm_id": 10, "anchor_age": 70}],
                icustay_detail=[{"stay_id": 100, "gender": "M", "race": "X"}])
    assert out["fisi9t_profile"].count() == 2
    up = out["fisi9t_unique_patient_profile"]
    assert_unique(up)
    r = uniqueness_report(up).collect()[0]
    assert (r.n_rows, r.n_keys, r.n_duplicated_keys) == (1, 1, 0)
