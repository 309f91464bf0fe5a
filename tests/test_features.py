"""Hourly features on hand-made fixtures (FIXTURES.md M1, M4-M13, M18, M19)."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions.time import round_to_hour
from tidemark.operators import grid as G
from tidemark.operators import hourly as H
from clinical_cases import frame, tables, ts

S, ST = 1, 100


def window_for(spark, intime, outtime):
    t = tables(spark, icustay_detail=[{"stay_id": ST, "icu_intime": intime, "icu_outtime": outtime}])
    cohort = spark.createDataFrame([(S, ST)], "subject_id int, stay_id int")
    w = G.stay_window(cohort, t.icustay_detail)
    return t, cohort, w, G.hour_grid(w)


def hours(df):
    return sorted(r.charttime_hour for r in df.collect())


def test_half_hour_rounding(spark):  # M1
    df = spark.createDataFrame([(ts("2130-03-13 10:29:59"),), (ts("2130-03-13 10:30:00"),)], "t timestamp_ntz")
    got = [r[0] for r in df.select(round_to_hour("t")).collect()]
    assert got == [ts("2130-03-13 10:00:00"), ts("2130-03-13 11:00:00")]


def test_grid_bounds(spark):  # M9
    _, _, _, g = window_for(spark, ts("2130-03-13 10:50:00"), ts("2130-03-13 12:10:00"))
    assert hours(g) == [ts(f"2130-03-13 {h}:00:00") for h in (10, 11, 12, 13)]


@pytest.mark.parametrize("outtime", [None, "2130-03-13 10:30:00"])
def test_null_or_reversed_window_has_no_grid(spark, outtime):  # M10, M11
    _, _, _, g = window_for(spark, ts("2130-03-13 12:00:00"), ts(outtime) if outtime else None)
    assert g.count() == 0


def vitals_rows(rows):
    return [{"subject_id": S, "stay_id": ST, "charttime": ts(t), **vals} for t, vals in rows]


def vitals_table(spark, rows, intime="2130-03-13 09:50:00", outtime="2130-03-13 13:10:00"):
    t, cohort, _, g = window_for(spark, ts(intime), ts(outtime))
    v = frame(spark, "vitalsign", vitals_rows(rows))
    return {r.charttime_hour: r for r in H.vitals_hourly(v, cohort, g).collect()}


def test_mean_of_cluster_means(spark):  # M4, M5
    got = vitals_table(spark, [("2130-03-13 10:00:00", {"heart_rate": 80.0}),
                               ("2130-03-13 10:01:00", {"heart_rate": 100.0}),
                               ("2130-03-13 10:20:00", {"heart_rate": 60.0})])
    row = got[ts("2130-03-13 10:00:00")]
    assert row.heart_rate == pytest.approx(75.0)
    assert row.sbp is None
    assert got[ts("2130-03-13 11:00:00")].heart_rate is None


def test_first_non_null_site_and_decimal_mean(spark):  # M6
    got = vitals_table(spark, [("2130-03-13 10:00:00", {"temperature": Decimal("36.50")}),
                               ("2130-03-13 10:05:00", {"temperature_site": "Oral"}),
                               ("2130-03-13 10:10:00", {"temperature_site": "Rectal",
                                                        "temperature": Decimal("37.00")})])
    row = got[ts("2130-03-13 10:00:00")]
    assert row.temperature_site == "Oral"
    assert row.temperature == pytest.approx(36.75)


def test_chained_cluster_lands_in_first_hour(spark):  # M3 through the table
    rows = [(f"2130-03-13 {8 + m // 60:02d}:{m % 60:02d}:00", {"resp_rate": 10.0}) for m in range(0, 241, 10)]
    got = vitals_table(spark, rows, intime="2130-03-13 07:50:00")
    assert got[ts("2130-03-13 08:00:00")].resp_rate == pytest.approx(10.0)
    assert all(got[ts(f"2130-03-13 {h:02d}:00:00")].resp_rate is None for h in (9, 10, 11, 12))


def test_vitals_not_bounded_by_stay(spark):  # M13
    got = vitals_table(spark, [("2130-03-13 09:45:00", {"spo2": 97.0})], intime="2130-03-13 10:50:00")
    assert got[ts("2130-03-13 10:00:00")].spo2 == pytest.approx(97.0)


def test_chemistry_policies(spark):  # M8, M12
    t, cohort, w, g = window_for(spark, ts("2130-03-13 10:00:00"), ts("2130-03-13 12:00:00"))
    chem = frame(spark, "chemistry", [
        {"subject_id": S, "charttime": ts("2130-03-13 10:00:00"), "bicarbonate": 20.0, "calcium": 8.0,
         "potassium": 4.0},
        {"subject_id": S, "charttime": ts("2130-03-13 10:10:00"), "bicarbonate": 24.0, "calcium": 9.0,
         "potassium": 4.4},
        {"subject_id": S, "charttime": ts("2130-03-13 12:00:00"), "sodium": 140.0},  # = outtime: kept
        {"subject_id": S, "charttime": ts("2130-03-13 12:00:01"), "sodium": 150.0},  # after: dropped
        {"subject_id": 2, "charttime": ts("2130-03-13 10:00:00"), "sodium": 1.0}])   # other subject
    got = {r.charttime_hour: r for r in H.chemistry_hourly(chem, w, g).collect()}
    r10 = got[ts("2130-03-13 10:00:00")]
    assert (r10.bicarbonate, r10.calcium, r10.potassium, r10.sodium) == (20.0, 8.5, 4.4, None)
    assert got[ts("2130-03-13 12:00:00")].sodium == 140.0
    assert len(got) == 4


def test_coagulation_last_non_null(spark):  # M7
    t, cohort, w, g = window_for(spark, ts("2130-03-13 10:00:00"), ts("2130-03-13 12:00:00"))
    coag = frame(spark, "coagulation", [
        {"subject_id": S, "charttime": ts("2130-03-13 10:00:00"), "inr": 1.1, "fibrinogen": 300.0},
        {"subject_id": S, "charttime": ts("2130-03-13 10:10:00"), "inr": 1.3, "fibrinogen": 250.0},
        {"subject_id": S, "charttime": ts("2130-03-13 10:20:00"), "d_dimer": 0.5}])
    r10 = {r.charttime_hour: r for r in H.coagulation_hourly(coag, w, g).collect()}[ts("2130-03-13 10:00:00")]
    assert (r10.inr, r10.fibrinogen, r10.d_dimer, r10.pt) == (1.3, 250.0, 0.5, None)


def test_procedures_unknown_item_and_empty_hours(spark):  # M12, M18, M19
    t, cohort, w, g = window_for(spark, ts("2130-03-13 10:00:00"), ts("2130-03-13 11:00:00"))
    procs = frame(spark, "procedureevents", [
        {"subject_id": S, "stay_id": ST, "storetime": ts("2130-03-13 10:00:00"), "itemid": 7, "orderid": 1},
        {"subject_id": S, "stay_id": ST, "storetime": ts("2130-03-13 10:00:00"), "itemid": 8, "orderid": 2},
        {"subject_id": S, "stay_id": ST, "storetime": ts("2130-03-13 11:00:00"), "itemid": 7, "orderid": 3},
        {"subject_id": S, "stay_id": ST, "storetime": None, "itemid": 7, "orderid": 4},
        {"subject_id": S, "stay_id": ST, "storetime": ts("2130-03-13 11:00:01"), "itemid": 7, "orderid": 5}])
    items = frame(spark, "d_items", [{"itemid": 7, "label": "Line"}])
    out = H.procedures_hourly(procs, w, items, g).orderBy("charttime_hour", "orderid").collect()
    got = [(r.charttime_hour.hour, r.orderid, r.item_label) for r in out]
    assert got == [(10, 1, "Line"), (10, 2, None), (11, 3, "Line"), (12, None, None)]


def test_hourly_tables_are_unique_per_stay_hour(spark):
    rows = [(f"2130-03-13 10:{m:02d}:00", {"heart_rate": float(m)}) for m in range(0, 60, 7)]
    t, cohort, _, g = window_for(spark, ts("2130-03-13 09:50:00"), ts("2130-03-13 13:10:00"))
    out = H.vitals_hourly(frame(spark, "vitalsign", vitals_rows(rows)), cohort, g)
    assert out.count() == g.count() == out.select("stay_id", "charttime_hour").distinct().count()
    assert out.filter(F.col("heart_rate").isNotNull()).count() >= 1
