"""Gap sessions: the cluster rule, bucket edges, and a brute-force property."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import types as T

from tidemark.operators.sessions import gap_sessions, gap_sessions_window, session_summary
from clinical_cases import ts

SCHEMA = T.StructType([T.StructField("stay_id", T.IntegerType()),
                       T.StructField("charttime", T.TimestampNTZType())])
GAP = timedelta(minutes=15)


def brute_force(rows):
    """Per stay, sorted by time: lag, flag, running sum over peers (RANGE frame)."""
    out = {}
    by_stay = {}
    for s, t in rows:
        by_stay.setdefault(s, []).append(t)
    for s, times in by_stay.items():
        distinct = sorted(set(times))
        cid, start, prev, ids = 0, None, None, {}
        for t in distinct:
            if prev is None or t - prev > GAP:
                cid, start = cid + 1, t
            ids[t] = (cid, start)
            prev = t
        for t in times:
            out.setdefault((s, t), ids[t])
    return out


def run(spark, rows, gap_minutes=15):
    df = spark.createDataFrame(rows, SCHEMA)
    got = gap_sessions(df, ["stay_id"], gap_minutes=gap_minutes).collect()
    return {(r.stay_id, r.charttime): (r.cluster_id, r.cluster_time) for r in got}, len(got)


def test_gap_of_exactly_15_minutes_stays_in_cluster(spark):  # M2
    rows = [(1, ts("2130-03-13 10:00:00")), (1, ts("2130-03-13 10:15:00")), (1, ts("2130-03-13 10:30:01"))]
    got, _ = run(spark, rows)
    assert got[(1, ts("2130-03-13 10:15:00"))] == (1, ts("2130-03-13 10:00:00"))
    assert got[(1, ts("2130-03-13 10:30:01"))] == (2, ts("2130-03-13 10:30:01"))


def test_chained_cluster_keeps_first_time(spark):  # M3, over many buckets and midnight
    start = ts("2130-03-13 20:07:00")
    rows = [(1, start + timedelta(minutes=10 * i)) for i in range(60)]  # 10 hours
    got, n = run(spark, rows)
    assert n == 60
    assert set(got.values()) == {(1, start)}


def test_peers_share_a_cluster(spark):  # rule 5
    rows = [(1, ts("2130-03-13 10:00:00")), (1, ts("2130-03-13 11:00:00")), (1, ts("2130-03-13 11:00:00"))]
    got, n = run(spark, rows)
    assert n == 3 and got[(1, ts("2130-03-13 11:00:00"))] == (2, ts("2130-03-13 11:00:00"))


def test_gap_exactly_at_bucket_edges(spark):
    # readings exactly 15 minutes apart on bucket boundaries, and 15 min 1 us apart
    base = ts("2130-03-13 10:00:00")
    rows = [(1, base), (1, base + timedelta(minutes=15)), (1, base + timedelta(minutes=30, microseconds=1)),
            (1, base + timedelta(minutes=44, seconds=59)), (1, base + timedelta(minutes=60))]
    got, _ = run(spark, rows)
    assert [got[(1, t)][0] for _, t in rows] == [1, 1, 2, 2, 3]
    assert got == brute_force(rows)


def test_null_times_are_dropped(spark):
    rows = [(1, None), (1, ts("2130-03-13 10:00:00"))]
    _, n = run(spark, rows)
    assert n == 1


def test_matches_brute_force_on_random_data(spark):
    rnd = random.Random(7)
    base = datetime(2130, 1, 1)
    rows = []
    for stay in range(6):
        t = base + timedelta(hours=rnd.randint(0, 30))
        for _ in range(rnd.randint(1, 150)):
            t += timedelta(minutes=rnd.choice([0, 1, 5, 14, 15, 16, 40, 300]), seconds=rnd.choice([0, 0, 1]))
            rows.append((stay, t))
    want = brute_force(rows)
    got, n = run(spark, rows)
    assert n == len(rows)
    assert got == want


def test_summary_and_session_window_agree(spark):
    rnd = random.Random(3)
    base = datetime(2130, 1, 1)
    rows = [(s, base + timedelta(minutes=rnd.randint(0, 3000))) for s in range(4) for _ in range(80)]
    df = spark.createDataFrame(rows, SCHEMA)
    a = {(r.stay_id, r.cluster_time, r.cluster_end, r.n_readings)
         for r in session_summary(df, ["stay_id"]).collect()}
    b = {(r.stay_id, r.cluster_time, r.cluster_end, r.n_readings)
         for r in gap_sessions_window(df, ["stay_id"]).collect()}
    assert a == b


def test_matches_brute_force_many_seeds(spark):
    steps = [timedelta(0), timedelta(minutes=15), timedelta(minutes=15, microseconds=1),
             timedelta(minutes=14, seconds=59, microseconds=999999), timedelta(minutes=30),
             timedelta(minutes=7, seconds=30), timedelta(hours=2), timedelta(microseconds=1)]
    rows = []
    for seed in range(8):
        rnd = random.Random(100 + seed)
        t = datetime(2130, 1, 1) + timedelta(minutes=15 * rnd.randint(0, 8))  # aligned starts too
        for _ in range(rnd.randint(20, 120)):
            t += rnd.choice(steps)
            rows.append((seed, t))
    got, n = run(spark, rows)
    assert n == len(rows)
    assert got == brute_force(rows)


def test_hot_stay_reduces_to_bucket_rows(spark):
    from pyspark.sql import functions as F

    from tidemark.operators.sessions import gap_buckets
    n = 100_000  # one stay, a reading every 0.864 s for a day, plus one quiet stay
    hot = spark.range(n).select(F.lit(1).alias("stay_id"),
                                (F.lit(ts("2130-03-13 00:00:00")) + F.make_dt_interval(
                                    secs=F.col("id") * 0.864)).cast("timestamp_ntz").alias("charttime"))
    cold = spark.createDataFrame([(2, ts("2130-03-13 05:00:00"))], SCHEMA)
    df = hot.unionByName(cold)
    assert gap_buckets(df, ["stay_id"]).filter("stay_id = 1").count() <= 96
    got = {r.stay_id: (r.cluster_id, r.n_readings) for r in session_summary(df, ["stay_id"]).collect()}
    assert got == {1: (1, n), 2: (1, 1)}
