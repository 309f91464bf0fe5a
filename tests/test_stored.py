"""Stored tables: constraints at publish, drop and vacuum, point access, buckets, ticks, search index, order, readiness."""

from __future__ import annotations

import os
import random
import tempfile
import threading

import pytest
from pyspark.sql import functions as F

from clinical_cases import tables, ts
from tidemark.operators import browse as B
from tidemark.operators import snapshot as P
from tidemark.plans import chain
from tidemark.plans import stored as K
from tidemark.plans.chain import ORDER, ConstraintError, drop, published, reading, refresh, vacuum, write_table
from tidemark.sources.surrogate import ClinicalTables

TIMES = ("2130-03-13 05:10:00", "2130-03-13 09:00:00")


def new_root() -> str:
    return tempfile.mkdtemp(prefix="tidemark-stored-")


def clinic(spark, subjects=(1, 2, 3), **more) -> ClinicalTables:
    """One stay, one coded diagnosis and a few readings of each subject."""
    rows = {
        "icustays": [{"subject_id": s, "hadm_id": 10 * s, "stay_id": 100 * s, "intime": ts(TIMES[0]), "outtime": ts(TIMES[1])} for s in subjects],
        "diagnoses_icd": [{"subject_id": s, "hadm_id": 10 * s, "seq_num": 1, "icd_code": "1", "icd_version": 9} for s in subjects],
        "d_icd_diagnoses": [{"icd_code": "1", "icd_version": 9, "long_title": "one"}],
        "age": [{"subject_id": s, "hadm_id": 10 * s, "anchor_age": 50} for s in subjects],
        "icustay_detail": [{"stay_id": 100 * s, "gender": "F", "icu_intime": ts(TIMES[0]), "icu_outtime": ts(TIMES[1])} for s in subjects],
        "vitalsign": [{"subject_id": s, "stay_id": 100 * s, "charttime": ts("2130-03-13 06:10:00"), "heart_rate": 80.0} for s in subjects]}
    return tables(spark, **{**rows, **more})


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# --- constraints ---------------------------------------------------------------------

def test_a_repeated_subject_publishes_nothing(spark, monkeypatch):
    root = new_root()
    refresh(spark, clinic(spark), root, ["first_icu_stay"])
    before, folders = published(spark, root), os.listdir(f"{root}/versions")
    monkeypatch.setattr(chain.C, "unique_profile", lambda p: p.select(*chain.OUTPUTS["fisi9t_unique_patient_profile"]))
    t = clinic(spark, diagnoses_icd=[{"subject_id": s, "hadm_id": 10 * s, "seq_num": k, "icd_code": "1", "icd_version": 9} for s in (1, 2) for k in (1, 2)])
    with pytest.raises(ConstraintError, match="fisi9t_unique_patient_profile: 4 rows repeat"):
        refresh(spark, t, root, ["fis_icd9"])
    assert published(spark, root) == before and os.listdir(f"{root}/versions") == folders and not os.listdir(f"{root}/leases")


def test_a_missing_key_publishes_nothing(spark):
    root = new_root()
    t = clinic(spark, icustays=[{"hadm_id": 10, "stay_id": 100, "intime": ts(TIMES[0])}])
    with pytest.raises(ConstraintError, match="1 have none"):
        refresh(spark, t, root)
    assert published(spark, root) == {} and not os.listdir(f"{root}/versions")


def test_counts_come_from_the_write_itself(spark):
    df = spark.range(1000).select((F.col("id") % 990).alias("subject_id"), F.lit("x").alias("v")).repartition(7)
    tracker, group = spark.sparkContext.statusTracker(), "count-in-write"
    jobs = []
    for unique in (None, ["subject_id"]):
        spark.sparkContext.setJobGroup(f"{group}-{unique}", group)
        counts = write_table(df, f"{new_root()}/t", ["subject_id"], unique=unique)
        jobs.append(sum(len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup(f"{group}-{unique}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts == {"n_rows": 1000, "n_repeated": 20, "n_null": 0}
    assert jobs[0] == jobs[1]  # no further scan and no further exchange


def test_hourly_tables_are_written_at_once_from_windows_that_are_computed_once(spark, monkeypatch):
    root, windows, together = new_root(), [], threading.Barrier(4, timeout=120)
    window, write = chain.G.stay_window, chain.write_table
    monkeypatch.setattr(chain.G, "stay_window", lambda *a: windows.append(a) or window(*a))
    monkeypatch.setattr(chain, "write_table", lambda df, path, *a: (os.path.basename(path) in chain.CALENDAR_TABLES and together.wait()) and None or write(df, path, *a))
    checks = {}
    paths = refresh(spark, clinic(spark), root, checks=checks)
    assert len(windows) == 1 and not together.broken and list(checks) == list(paths) == ORDER
    assert sorted(os.listdir(os.path.dirname(paths[ORDER[0]]))) == sorted(ORDER)  # the windows are gone
    built = chain.build_tables(clinic(spark))
    for name in sorted(chain.CALENDAR_TABLES):
        stored = spark.read.parquet(paths[name]).select(*chain.OUTPUTS[name])
        assert sorted(map(repr, stored.collect())) == sorted(map(repr, built[name].select(*chain.OUTPUTS[name]).collect())), name
        assert checks[name]["n_rows"] == 3 * 6


def test_one_bad_table_of_several_at_once_publishes_nothing(spark, monkeypatch):
    root, hourly = new_root(), chain.H.chemistry_hourly
    monkeypatch.setattr(chain.H, "chemistry_hourly", lambda *a: hourly(*a).unionByName(hourly(*a)))
    with pytest.raises(ConstraintError, match="fisi9t_chemistry_hourly: 36 rows repeat"):
        refresh(spark, clinic(spark), root)
    assert published(spark, root) == {} and not os.listdir(f"{root}/versions") and not [f for f in os.listdir(f"{root}/leases") if not f.startswith(".")]


# --- drop and vacuum -------------------------------------------------------------------

def test_drop_cascades_and_vacuum_keeps_what_is_read(spark):
    root = new_root()
    refresh(spark, clinic(spark), root)
    with pytest.raises(ValueError, match="depend on"):
        drop(spark, root, ["fisi9t_profile"], cascade=False)
    with reading(spark, root) as have:
        assert drop(spark, root, ["fisi9t_profile"]) == ORDER[3:] and list(published(spark, root)) and set(published(spark, root)) == set(ORDER[:3])
        assert vacuum(spark, root) == []  # held by the reader
        assert spark.read.parquet(have["fisi9t_vitalsign_hourly"]).count() == 3 * 6
    gone = vacuum(spark, root)
    assert sorted(os.path.basename(p) for p in gone) == sorted(ORDER[3:]) and not any(map(os.path.exists, gone))
    assert spark.read.parquet(published(spark, root)["fis_icd9"]).count() == 3
    # a dropped table comes back with its inputs, and a drop of what is not there does nothing
    assert list(refresh(spark, clinic(spark, (1, 2)), root, ["fisi9t_chemistry_hourly"])) == ORDER[3:5] + ["fisi9t_chemistry_hourly"]
    assert drop(spark, root, ["fisi9t_vitalsign_hourly"]) == []
    refresh(spark, clinic(spark), root)
    vacuum(spark, root)
    assert len(os.listdir(f"{root}/versions")) == 1 and vacuum(spark, root) == []
    assert drop(spark, root, ORDER) == ORDER and published(spark, root) == {}
    vacuum(spark, root)
    assert os.listdir(f"{root}/versions") == []


def test_leases_end_and_a_refresh_at_work_is_left_alone(spark):
    root = new_root()
    os.makedirs(f"{root}/versions/1-lost/first_icu_stay")
    os.makedirs(f"{root}/versions/2-busy/first_icu_stay")
    chain.hold(spark, root, [f"{root}/versions/1-lost"], seconds=-5)
    chain.hold(spark, root, [f"{root}/versions/2-busy"])
    assert [p.split("/")[-2] for p in vacuum(spark, root)] == ["1-lost"]
    assert os.listdir(f"{root}/versions") == ["2-busy"] and len([f for f in os.listdir(f"{root}/leases") if not f.startswith(".")]) == 1


# --- point access ----------------------------------------------------------------------

def scan_rows(df) -> int:
    """Rows that the plan's file scans put out, once it has run."""
    df.collect()

    def leaves(node):
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return leaves(node.executedPlan())
        kids = node.children()
        return [node] if not kids.size() else [x for i in range(kids.size()) for x in leaves(kids.apply(i))]
    return sum(x.metrics().apply("numOutputRows").value() for x in leaves(df._jdf.queryExecution().executedPlan()))


def test_an_absent_stay_reads_no_row_group(spark):
    """The id lies between the least and greatest of every file, so that only a Bloom filter can tell."""
    path = f"{new_root()}/profile"
    ids = spark.range(40_000).select((F.col("id") * 7).alias("subject_id"), (F.hash("id").cast("long") * 3).alias("stay_id"),
                                     F.col("id").alias("hadm_id"))
    write_table(ids.coalesce(1), path, ["subject_id"], unique=["subject_id"])
    stored = spark.read.parquet(path)
    for column, there in (("subject_id", 7 * 1234), ("stay_id", ids.first()["stay_id"])):
        assert scan_rows(stored.where(F.col(column) == there)) > 0
        for absent in (there + 1, there + 2):
            assert scan_rows(stored.where(F.col(column) == absent)) == 0
    with pytest.raises(LookupError):
        P.lookup_one(stored, 7 * 1234 + 1, 0, 0)


# --- buckets ---------------------------------------------------------------------------

def test_bucketed_tables_join_without_an_exchange(spark):
    grid = spark.range(200).select((F.col("id") % 5).alias("subject_id"), (F.col("id") % 5 + 100).alias("stay_id"),
                                   F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit("2130-03-13").cast("timestamp_ntz")).alias("charttime_hour"))
    hourly = grid.where(F.hour("charttime_hour") < 9).withColumn("heart_rate", F.col("stay_id") * 1.0)
    out = K.bucketed_on_grid(spark, grid, hourly, new_root(), 4)
    assert out.count() == 200 and out.where("heart_rate IS NOT NULL").count() == hourly.count()
    text = plan(out)
    assert "Exchange" not in text and "SortMergeJoin" in text and "Bucketed: true" in text


# --- ticks -----------------------------------------------------------------------------

def test_ticks_prune_calendar_directories(spark):
    root = new_root()
    days = [ts(f"2130-{m:02d}-{d:02d} 00:00:00") for m in (1, 3) for d in (1, 2, 3, 13)]
    v = spark.createDataFrame([(i, 100 * i, d) for i in (1, 2) for d in days], "subject_id long, stay_id long, day timestamp_ntz") \
        .select("subject_id", "stay_id", F.explode(F.expr("sequence(day, day + interval 23 hours, interval 1 hour)")).alias("charttime_hour"))
    v = v.select("*", *[F.lit(1.0).alias(c) for c in P.DELTA_VITAL_COLUMNS[3:]])
    write_table(chain.with_calendar(v), f"{root}/v", ["stay_id", "charttime_hour"], partition_by=chain.CALENDAR_COLUMNS)
    patients = spark.createDataFrame([(1, 100, ts("2130-03-13 05:10:00")), (2, 200, ts("2151-03-13 22:00:00"))], "subject_id long, stay_id long, intime timestamp_ntz")
    ticks = spark.createDataFrame([(3, d, h) for d in (13, 14) for h in range(-1, 24)], "tick_month int, tick_day int, tick_hour int")
    stored = spark.read.parquet(f"{root}/v")
    out = P.delta_vitals_at_ticks(stored, patients, ticks)
    assert "dynamicpruning" in plan(out)
    got = sorted((r.tick_hour, r.stay_id) for r in out.collect())
    assert {r.tick_day for r in out.collect()} == {13}
    want = []
    for h in range(-1, 24):  # each tick equals the query of one tick
        day = patients.where("month(intime) = 3 AND day(intime) = 13")
        want += [(h, r.stay_id) for r in P.delta_vitals(stored, day, 3, 13, h).collect()]
    assert got == sorted(want) and len(got) == 19 + 2


# --- search index ------------------------------------------------------------------------

def test_indexed_search_equals_the_scan(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, i, 7 * i]), 30_000_000 + rng.randrange(5000), rng.choice([None, 20_000_000 + i])) for i in range(400)]
    profile = spark.createDataFrame(rows, "subject_id long, stay_id long, hadm_id long")
    grams = B.id_grams(profile)
    texts = [str(x) for r in rows for x in r if x is not None]
    queries = ["", "30", "3000", "x12", "300 200 7", "99999999"]
    for _ in range(12):
        some = [rng.choice(texts) for _ in range(rng.randrange(1, 3))]
        queries.append(" ".join(t[i:i + rng.randrange(1, 7)] for t in some for i in [rng.randrange(len(t))]))
    for q in queries:
        assert sorted(map(repr, B.id_search_indexed(profile, grams, q).collect())) == sorted(map(repr, B.id_search(profile, q).collect())), q


# --- order -------------------------------------------------------------------------------

def test_order_check_is_red_on_shuffled_copies(spark, monkeypatch):
    monkeypatch.setattr(K, "CHUNK_ROWS", 64)
    root = new_root()
    df = spark.range(3000).select((F.col("id") % 300).alias("stay_id"), (F.col("id") / 300).cast("int").alias("h"), (F.col("id") % 2).alias("part"))
    df = df.unionByName(spark.createDataFrame([(None, 3, 1)], df.schema))
    keys = ["stay_id", "h"]
    write_table(df, f"{root}/good", keys)
    write_table(df, f"{root}/parts", keys, partition_by=["part"])
    check = lambda path, *parts: tuple(K.order_check(spark, path, keys, parts).first())
    assert check(f"{root}/good") == check(f"{root}/parts", "part") == (3001, 0, 0)
    df.repartition(3).write.parquet(f"{root}/shuffled")
    rows, low, over = check(f"{root}/shuffled")
    assert rows == 3001 and low > 500 and over == 2
    df.orderBy(*keys).coalesce(1).write.parquet(f"{root}/one")
    assert check(f"{root}/one") == (3001, 0, 0)
    # sorted files with overlapping ranges, and one swapped pair across chunks
    df.repartition(2).sortWithinPartitions(*keys).write.parquet(f"{root}/overlap")
    assert check(f"{root}/overlap")[1:] == (0, 1)
    swapped = spark.range(1000).select(F.when(F.col("id") == 63, 64).when(F.col("id") == 64, 63).otherwise(F.col("id")).alias("stay_id"), F.lit(0).alias("h"))
    swapped.coalesce(1).write.parquet(f"{root}/swapped")
    assert check(f"{root}/swapped")[1:] == (1, 0)


# --- readiness ---------------------------------------------------------------------------

def test_readiness_counts_from_footers(spark):
    root = new_root()
    spark.range(500).write.parquet(f"{root}/some")
    spark.range(0).write.parquet(f"{root}/empty")
    counted = K.footer_counts(spark, f"{root}/some")
    assert counted.first().n_rows == 500 and "PushedAggregation: [COUNT(*)]" in plan(counted)
    report = K.readiness_report(spark, {"some": f"{root}/some", "empty": f"{root}/empty", "gone": f"{root}/no"},
                                {"some": ["id"], "empty": ["id"], "gone": ["id"], "never": ["a", "b"]})
    assert {r.table: (r.ready, r.n_rows, r.missing) for r in report.collect()} == {
        "some": (True, 500, ""), "empty": (False, 0, ""), "gone": (False, None, "id"), "never": (False, None, "a,b")}
    lacking = K.readiness_report(spark, {"some": f"{root}/some"}, {"some": ["id", "name"]}).first()
    assert not lacking.ready and lacking.missing == "name"
    assert spark.conf.get("spark.sql.sources.useV1SourceList") != ""


# --- the clock's response -------------------------------------------------------------------

def test_clock_response_is_the_ticks_document(spark):
    import json
    from pyspark.sql import types as T
    from tidemark.functions.time import display_clock
    patients = spark.createDataFrame([(1, 100, 10, 60, "F", None, "MICU", ts("2130-03-13 05:10:00"), None, 1.5),
                                      (2, 200, 20, 61, "M", "X", "MICU", ts("2130-03-13 07:10:00"), None, None)],
                                     "subject_id long, stay_id long, hadm_id long, anchor_age short, gender string, race string, first_careunit string, "
                                     "intime timestamp_ntz, outtime timestamp_ntz, los double")
    vitals = spark.createDataFrame([(1, 100, ts("2130-03-13 05:00:00")), (1, 100, ts("2130-03-13 06:00:00"))], "subject_id long, stay_id long, charttime_hour timestamp_ntz")
    vitals = vitals.select("*", *[F.lit(None).cast(T.DoubleType()).alias(c) for c in P.DELTA_VITAL_COLUMNS[3:]])
    procedures = vitals.select(*["subject_id", "stay_id", "charttime_hour"], *[F.lit(None).cast("string").alias(c) for c in P.DELTA_PROCEDURE_COLUMNS[3:]]).limit(0)
    for hour, counts in ((5, (1, 1, 1, 0)), (8, (0, 2, 0, 0)), (-1, (0, 0, 0, 0))):
        v, p = (f(x, patients, 3, 13, hour) for f, x in ((P.delta_vitals, vitals), (P.delta_procedures, procedures)))
        rows = P.clock_response(patients, v, p, hour, display_clock(F.lit(hour), F.lit("2025-03-13"))).collect()
        head = json.loads(next(r.json for r in rows if r.section == "response"))
        assert tuple(head[k] for k in ("new_patients_count", "total_admitted", "vitalsigns_count", "procedureevents_count")) == counts
        assert head["current_hour"] == hour and len(rows) == 1 + counts[0] + counts[2] + counts[3]
        if hour == 5:
            new = json.loads(next(r.json for r in rows if r.section == "new_patients"))
            assert list(new) == P.NEW_PATIENT_COLUMNS and new["race"] is None and new["intime"] == "2130-03-13T05:10:00"
