"""Binned joins of readings and events with stay windows (J11, J12), the key filter, and paging."""

from __future__ import annotations

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from clinical_cases import frame, ts
from tidemark.operators import grid as G
from tidemark.operators import hourly as H
from tidemark.operators import snapshot as P
from tidemark.operators.key_filter import key_filter, may_hold
from tidemark.plans.queries import queries

SF = "/root/testdata/sf0.001"
BASE = ts("2130-03-13 00:00:00")


def windows(spark, rows):
    df = spark.createDataFrame(rows, "subject_id long, stay_id long, icu_intime timestamp_ntz, icu_outtime timestamp_ntz")
    return G.timed_window(df)


def moment(rng) -> timedelta:
    """Often on an hour, half an hour or a microsecond beside one."""
    return timedelta(minutes=rng.choice([30, 15, 1]) * rng.randrange(40), microseconds=rng.choice([0, 0, -1, 1]))


def case(seed):
    """Overlapping stays of a few subjects, some of them empty, open or reversed, and readings around their edges."""
    rng = random.Random(seed)
    stays = []
    for k in range(6):
        a, b = BASE + moment(rng), BASE + moment(rng)
        if rng.random() < 0.8:
            a, b = min(a, b), max(a, b)
        stays.append((rng.randrange(1, 4), 100 + k, a, rng.choice([b, b, b, None])))
    edges = [x for s in stays for x in s[2:] if x]
    times = [rng.choice(edges) + rng.choice([timedelta(0), timedelta(microseconds=1), -timedelta(microseconds=1), moment(rng)]) for _ in range(150)]
    return stays, [(rng.randrange(1, 5), t, rng.choice([None, float(rng.randrange(50))]), i) for i, t in enumerate([*times, None])]


def hour_of(t):
    t += timedelta(minutes=30)
    return t.replace(minute=0, second=0, microsecond=0)


def grid_of(stays):
    for s, stay, a, b in stays:
        if b is None:
            continue
        h, last = a.replace(minute=0, second=0, microsecond=0), b.replace(minute=0, second=0, microsecond=0) + timedelta(hours=1)
        while h <= last:
            yield s, stay, a, b, h
            h += timedelta(hours=1)


@pytest.mark.parametrize("seed", range(6))
def test_labs_and_procedures_equal_a_plain_range_join(spark, seed):
    stays, readings = case(seed)
    w = windows(spark, stays)
    chem = frame(spark, "chemistry", [{"subject_id": s, "charttime": t, "bicarbonate": v, "calcium": v, "potassium": v} for s, t, v, _ in readings])
    coag = frame(spark, "coagulation", [{"subject_id": s, "charttime": t, "inr": v, "fibrinogen": v} for s, t, v, _ in readings])
    procs = frame(spark, "procedureevents", [{"subject_id": s, "stay_id": 100 + i % 7, "storetime": t, "itemid": 7, "orderid": i} for s, t, _, i in readings])
    chem_rows = {(r.stay_id, r.charttime_hour): r for r in H.chemistry_hourly(chem, w).collect()}
    coag_rows = {(r.stay_id, r.charttime_hour): r for r in H.coagulation_hourly(coag, w).collect()}
    events = [(r.stay_id, r.charttime_hour, r.orderid) for r in H.procedures_hourly(procs, w, frame(spark, "d_items", [])).collect()]
    want_events = []
    cells = list(grid_of(stays))
    assert len(chem_rows) == len(coag_rows) == len(cells)
    for s, stay, a, b, h in cells:
        inside = [(t, v) for x, t, v, _ in readings if x == s and t and a <= t <= b and hour_of(t) == h and v is not None]
        values = [v for _, v in inside]
        r, q = chem_rows[stay, h], coag_rows[stay, h]
        assert (r.bicarbonate, r.potassium, r.sodium) == (min(values, default=None), max(values, default=None), None)
        assert r.calcium == (pytest.approx(sum(values) / len(values)) if values else None)
        assert (q.inr, q.fibrinogen) == (max(inside)[1] if inside else None, min(values, default=None))
        mine = [i for x, t, _, i in readings if x == s and 100 + i % 7 == stay and t and a <= t <= b and hour_of(t) == h]
        want_events += [(stay, h, i) for i in mine or [None]]
    assert sorted(events, key=repr) == sorted(want_events, key=repr)


def test_a_hot_subject_crosses_exchanges_as_hours(spark):
    """Broadcasts off, one subject with nearly all readings: what the first exchange gets are rows per hour, but for edge hours."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    w = windows(spark, [(1, 100, ts("2130-03-13 00:10:00"), ts("2130-03-13 20:10:00")), (2, 200, BASE, BASE + timedelta(hours=3))])
    chem = spark.range(200_000).select(F.lit(1).cast("long").alias("subject_id"), F.timestamp_add("SECOND", (F.col("id") % 86_400).cast("int"), F.lit(BASE).cast("timestamp_ntz")).alias("charttime"),
                                       *[F.col("id").cast("double").alias(c) for c in ("bicarbonate", "calcium", "sodium", "potassium")]).coalesce(4)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = H.chemistry_hourly(chem, w)
        assert out.count() == 22 + 5
        out.collect()
        counts = exchanged_rows(out)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # four tasks: 24 hours each, and the distinct seconds of the stays' four edge hours at most
    assert counts and max(counts) <= 4 * 25 + 4 * 4 * 3600 < 200_000 / 3


def exchanged_rows(df) -> list[int]:
    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        mine = [node.metrics().apply("shuffleRecordsWritten").value()] if name == "ShuffleExchangeExec" else []
        kids = node.children()
        return mine + [x for i in range(kids.size()) for x in walk(kids.apply(i))]
    return walk(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("name", ["chemistry_hourly", "coagulation_hourly", "procedures_hourly"])
def test_readings_are_scanned_once_and_thinned_before_an_exchange(spark, name):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    lines = text.split("\n")
    scans = [i for i, x in enumerate(lines) if "FileScan" in x and "value" in x.split("Batched")[0]]
    assert len(scans) == 1
    depth = lambda x: max(x.find("+- "), x.find(":- "))
    between, at = "", depth(lines[scans[0]])
    for x in reversed(lines[:scans[0]]):  # the scan's ancestors up to the first exchange
        if depth(x) < at:
            if "Exchange" in x:
                break
            between, at = between + x + "\n", depth(x)
    if name == "procedures_hourly":
        assert "element_at(" in between and "subquery#" in between  # the key filter
    else:
        assert "partial_" in between


def test_key_filter_never_loses_a_key(spark):
    keys = spark.range(0, 30_000, 3).select(F.col("id").alias("a"), F.concat(F.lit("k"), F.col("id")).alias("b"))
    rows = spark.range(30_000).select("id", F.concat(F.lit("k"), F.col("id")).alias("b"))
    kept = rows.where(may_hold(key_filter(keys, [F.col("a"), F.col("b")]), [F.col("id"), F.col("b")]))
    assert kept.where("id % 3 = 0").count() == 10_000
    assert kept.where("id % 3 > 0").count() < 200  # two of 2^20 bits a key
    assert rows.where(may_hold(key_filter(keys.limit(0), [F.col("a"), F.col("b")]), [F.col("id"), F.col("b")])).isEmpty()


@pytest.mark.parametrize("n,requested,page,pages", [
    (1003, 1, 1, 41), (1003, 2, 2, 41), (1003, 41, 41, 41), (1003, 40, 40, 41), (1003, 42, 41, 41), (1003, 0, 41, 41), (1003, -3, 41, 41),
    (1003, "x", 1, 41), (1003, None, 1, 41), (1003, "17", 17, 41), (1003, 10**12, 41, 41), (25, 1, 1, 1), (26, 2, 2, 2), (1, 5, 1, 1)])
def test_pages_of_a_scattered_list(spark, n, requested, page, pages):
    ids = sorted(random.Random(n).sample(range(-10**9, 10**12), n))
    df = spark.createDataFrame([(i,) for i in random.Random(1).sample(ids, n)], "subject_id long").repartition(3)
    rows = P.patient_page(df, requested).collect()
    assert sorted(r.subject_id for r in rows) == ids[(page - 1) * 25:page * 25]
    assert {(r.page, r.num_pages, r.total_patients) for r in rows} == {(page, pages, n)}


def test_pages_run_no_job_before_the_plan_and_rank_one_range(spark):
    df = spark.range(100_000).withColumnRenamed("id", "subject_id")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("paging", "paging")
    page = P.patient_page(df, 3900)
    assert not tracker.getJobIdsForGroup("paging")
    assert [r.subject_id for r in page.sort("subject_id").collect()] == list(range(3899 * 25, 3900 * 25))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    text = page._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in text and "GlobalLimit" not in text
    assert P.patient_page(df.limit(0), 1).count() == 0
