"""Clock, cohort, paging, census, browse and display rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.functions import display as D
from tidemark.functions.time import display_clock
from tidemark.operators import browse as B
from tidemark.operators import selection as SEL
from tidemark.operators import snapshot as P
from clinical_cases import ts

PROFILE_SCHEMA = ("subject_id int, anchor_age short, gender string, race string, hadm_id int, stay_id int, "
                  "first_careunit string, last_careunit string, intime timestamp_ntz, outtime timestamp_ntz, "
                  "los double")


def profile(spark, rows):
    full = [(s, a, g, r, h, st, cu, cu, ts(i), ts(o) if o else None, 1.0)
            for s, a, g, r, h, st, cu, i, o in rows]
    return spark.createDataFrame(full, PROFILE_SCHEMA)


@pytest.fixture()
def people(spark):
    return profile(spark, [
        (1, 60, "M", "WHITE", 10, 100, "MICU", "2130-03-13 05:10:00", "2130-03-13 04:00:00"),
        (2, 0, "F", "BLACK/AFRICAN AMERICAN OTHER", 20, 200, "SICU", "2151-03-13 05:40:00", None),
        (3, 70, "X", None, 30, 300, "", "2130-03-13 07:00:00", None),
        (4, 50, None, "ASIAN", 40, 400, "MICU", "2130-03-14 01:00:00", None)])


def test_clock_ignores_year_and_discharge(spark, people):  # M20, M21
    on_day = SEL.admitted_on(people, 3, 13)
    assert sorted(r.subject_id for r in SEL.admitted_as_of(on_day, 5).collect()) == [1, 2]
    assert SEL.admitted_as_of(on_day, -1).count() == 0
    assert sorted(r.subject_id for r in SEL.admitted_at(on_day, 7).collect()) == [3]


def test_cohort_precedence(spark, people):  # M23
    triples = spark.createDataFrame([(1, 100, 10), (2, 999, 20)], "subject_id int, stay_id int, hadm_id int")
    ids = spark.createDataFrame([(3,)], "subject_id int")
    assert [r.subject_id for r in SEL.select_cohort(people, triples, ids).collect()] == [1]
    assert [r.subject_id for r in SEL.select_cohort(people, None, ids).collect()] == [3]
    assert SEL.select_cohort(people).count() == 4
    kind, rel = SEL.cohort_relation(spark, [], [3])
    assert kind == "subject_ids" and rel.count() == 1
    assert SEL.cohort_relation(spark, [], []) is None


def test_paging_clamp(spark):  # M22
    assert P.resolve_page("x", 60) == (1, 3)
    assert P.resolve_page(3, 60) == (3, 3)
    assert P.resolve_page(99, 60) == (3, 3)
    assert P.resolve_page(0, 60) == (3, 3)
    assert P.resolve_page(1, 0) == (1, 1)
    df = spark.range(60).select((F.col("id") + 1).cast("int").alias("subject_id"))
    page = P.patient_page(df, 3).collect()
    assert [r.subject_id for r in page] == list(range(51, 61))
    assert (page[0].page, page[0].num_pages, page[0].total_patients) == (3, 3, 60)


def test_display_clock(spark):  # M24
    df = spark.createDataFrame([(-1,), (0,), (22,), (23,)], "h int")
    got = [r[0] for r in df.select(display_clock(F.col("h"), F.lit("2025-03-13"))).collect()]
    assert got == ["March 13, 2025 00:00", "March 13, 2025 01:00", "March 13, 2025 23:00",
                   "March 14, 2025 00:00"]


def test_display_rows(spark, people):
    got = {r.subject_id: r for r in D.patient_rows(people).collect()}
    assert (got[1].age_text, got[1].gender_text, got[1].admitted_text) == ("60", "Male", "Mar 13, 2130 05:10")
    assert (got[2].age_text, got[2].gender_text, got[2].race_text) == ("-", "Female", "BLACK/AFRICAN AMERI…")
    assert (got[3].gender_text, got[3].race_text, got[3].careunit_text) == ("X", "-", "-")
    assert got[4].gender_text == "-"


def test_facets_and_search(spark, people):
    facets = {(r.facet, r.value): r.n for r in B.facet_counts(people).collect()}
    assert facets[("first_careunit", "MICU")] == 2 and facets[("gender", "F")] == 1
    assert sorted(r.subject_id for r in B.id_search(people, "00 2").collect()) == [2]
    assert B.id_search(people, "").count() == 4
    assert [r.subject_id for r in B.browse_rows(people, {"gender": "M"}).collect()] == [1]


def test_census_matches_ticks(spark, people):
    grid_rows = [(1, 100, ts(f"2130-03-13 {h:02d}:00:00")) for h in range(3, 9)] + \
                [(2, 200, ts(f"2151-03-13 {h:02d}:00:00")) for h in range(5, 8)]
    vitals = spark.createDataFrame(grid_rows, "subject_id int, stay_id int, charttime_hour timestamp_ntz")
    on_day = SEL.admitted_on(people, 3, 13)
    census = {r.hour: r for r in P.hourly_census(spark, on_day, vitals, vitals, 3, 13).collect()}
    assert len(census) == 24
    assert census[0].current_time == "March 13, 2025 01:00"
    assert census[23].current_time == "March 14, 2025 00:00"
    assert census[5].new_patients == 2 and census[5].total_admitted == 2
    assert census[7].total_admitted == 3
    assert sum(r.new_patients for r in census.values()) == census[23].total_admitted
    for h in range(24):  # each tick equals the per-hour delta
        want = vitals.filter(F.hour("charttime_hour") == h).join(
            SEL.admitted_as_of(on_day, h).select("stay_id"), "stay_id", "left_semi").count()
        assert census[h].vitalsigns_count == want, h


def test_row_labels_and_key(spark, people):
    r = people.select(D.row_label().alias("l"), D.composite_key().alias("k")).orderBy("k").first()
    assert r.l == "Patient 1 - Stay 100" and tuple(r.k) == (1, 100, 10)
    v = spark.createDataFrame([(7, ts("2130-03-13 10:00:00"), None)],
                              "subject_id int, charttime_hour timestamp_ntz, item_label string")
    got = v.select(D.row_label("vitals"), D.row_label("procedure")).first()
    assert tuple(got) == ("Vitals for 7 at 2130-03-13 10:00:00", "Procedure for 7 - None")


def test_readiness_report(spark, people):
    from tidemark.operators.quality import readiness
    people.createOrReplaceTempView("fisi9t_unique_patient_profile")
    rep = readiness(spark, "fisi9t_unique_patient_profile", ["subject_id", "stay_id", "anchor_age", "gender"])
    assert rep["ok"] and rep["count"] == 4 and len(rep["sample"]) == 4 and rep["database"]
    assert rep["engine_version"] == spark.version
    assert readiness(spark, "no_such_table")["ok"] is False


def test_lookup_one_and_batch(spark, people):  # P13
    assert P.lookup_one(people, 1, 100, 10).count() == 1
    with pytest.raises(LookupError):
        P.lookup_one(people, 1, 100, 11)
    req = spark.createDataFrame([(1, 100, 10), (1, 100, 11), (1, 100, 10)],
                                "subject_id int, stay_id int, hadm_id int")
    got = sorted((r.hadm_id, r.found, r.anchor_age) for r in P.patient_lookup(people, req).collect())
    assert got == [(10, True, 60), (11, False, None)]


def test_ordered_timeline(spark, people):
    rows = [(1, 100, ts(f"2130-03-13 {h:02d}:00:00")) for h in (4, 2, 3)]
    cols = ["heart_rate", "sbp", "dbp", "mbp", "resp_rate", "temperature", "spo2", "glucose"]
    v = spark.createDataFrame(rows, "subject_id int, stay_id int, charttime_hour timestamp_ntz") \
        .select("*", *[F.lit(None).cast("double").alias(c) for c in cols])
    got = [r.hour_label for r in P.vitals_timeline(v, people, 3, 13, 3, ordered=True).collect()]
    assert got == ["02:00", "03:00"]


def test_procedure_display_rules(spark):
    rows = [(1, 100, ts("2130-03-13 10:00:00"), ts("2130-03-13 10:05:00"), "Line", 12.5, "mL", "Imaging", "Done"),
            (1, 100, ts("2130-03-13 11:00:00"), None, None, 0.0, None, "Lines", ""),
            (1, 100, ts("2130-03-13 12:00:00"), None, "", None, None, None, None)]
    log = spark.createDataFrame(rows, "subject_id int, stay_id int, charttime_hour timestamp_ntz, "
                                      "charttime timestamp_ntz, item_label string, value double, valueuom string, "
                                      "ordercategoryname string, statusdescription string")
    got = [(r.label_text, r.time_text, r.value_text, r.category_text)
           for r in D.procedure_rows(log).orderBy("charttime_hour").collect()]
    assert got == [("Line", "10:00", "Value: 12.5 mL", "Imaging · Done"),
                   ("-", "11:00", None, "Lines"),
                   ("-", "12:00", None, None)]
