"""Plan checks over every registered query, the driver contract, and the refresh chain."""

from __future__ import annotations

import os
import tempfile

import pytest

import __spark_entry__ as E
from duckdb_oracle import oracle_sql
from tidemark.plans.chain import ORDER, published, refresh
from tidemark.plans.queries import STORED, queries
from tidemark.schemas import OUTPUTS
from tidemark.sources.surrogate import surrogate_tables

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "CartesianProduct",
             "BroadcastNestedLoopJoin")


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_an_oracle():
    assert set(queries()) == set(oracle_sql())
    assert set(queries()) <= set(E.queries()) and set(oracle_sql()) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_plan_is_jvm_only_and_reads_given_tables(spark, name):
    df = queries()[name](spark, SF)
    text = plan_text(df)
    for bad in FORBIDDEN:
        assert bad not in text, f"{name}: {bad}"
    if name not in STORED:
        assert df.inputFiles() and all(f.startswith(f"file://{SF}/") for f in df.inputFiles())


def test_each_call_runs_the_whole_plan(spark):
    a, b = queries()["vitals_hourly"](spark, SF), queries()["vitals_hourly"](spark, SF)
    assert a is not b
    stages = []
    tracker = spark.sparkContext.statusTracker()
    for i, df in enumerate((a, b)):
        spark.sparkContext.setJobGroup(f"whole-{i}", "whole plan")
        df.collect()
        stages.append(sum(len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup(f"whole-{i}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert stages[0] == stages[1] > 0


def exchanges_above_scan(text: str) -> list[str]:
    """The plan's lines from a vitals scan upwards to the first exchange."""
    lines = text.split("\n")
    at = next(i for i, x in enumerate(lines) if "FileScan" in x and "event_type" in x and "value" in x)
    up = next(i for i in range(at, -1, -1) if "Exchange" in lines[i])
    return lines[up:at]


def test_vitals_scan_once_and_reduce_before_exchange(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = queries()["session_means"](spark, SF)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    scans = [x for x in plan.split("\n") if "FileScan" in x and "event_type" in x and "value" in x]
    assert len(scans) == 1  # other scans of events read no value
    assert any("partial_sum" in x for x in exchanges_above_scan(plan))


def test_scans_are_pruned(spark):
    df = E.queries()["chemistry_hourly"](spark, SF)
    text = plan_text(df)
    # the given tables are read with only the columns the query uses
    assert "ReadSchema: struct<c_custkey:bigint,c_nationkey" in text
    assert "p_name" not in text and "p_retailprice" not in text
    assert "PushedFilters: [IsNotNull(ts), IsNotNull(user_id)" in text


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == OUTPUTS["fisi9t_chemistry_hourly"]
    assert df.count() > 0


def test_refresh_writes_chain_in_order(spark):
    out = tempfile.mkdtemp(prefix="tidemark-refresh-")
    t = surrogate_tables(spark, SF)
    paths = refresh(spark, t, out)
    assert list(paths) == ORDER
    for name in ORDER:
        df = spark.read.parquet(paths[name])
        assert df.columns[:len(OUTPUTS[name])] == OUTPUTS[name]
    assert spark.read.parquet(paths["fisi9t_unique_patient_profile"]).count() == 12
    # calendar partitions prune the clock filter at directory level
    vit = spark.read.parquet(paths["fisi9t_vitalsign_hourly"]).filter("chart_month = 1 AND chart_day = 1")
    assert "PartitionFilters: [isnotnull(chart_month" in plan_text(vit)
    # asking for a table rebuilds it and what depends on it, nothing else
    again = refresh(spark, t, out, ["fisi9t_chemistry_hourly"])
    assert list(again) == ["fisi9t_chemistry_hourly"]
    now = published(spark, out)
    assert now == {**paths, **again} and list(refresh(spark, t, out, ["fisi9t_profile"])) == ORDER[3:]
    assert not [f for _, d, f in os.walk(out) for x in d if x.endswith(".raw")]


def test_two_refreshes_at_once_publish_whole_tables(spark):
    from concurrent.futures import ThreadPoolExecutor
    out = tempfile.mkdtemp(prefix="tidemark-race-")
    t = surrogate_tables(spark, SF)
    with ThreadPoolExecutor(2) as pool:
        both = list(pool.map(lambda _: refresh(spark, t, out, ["first_icu_stay"]), range(2)))
    now = published(spark, out)
    assert set(now) == set(ORDER) and {p.rsplit("/", 1)[0] for p in now.values()} <= {p.rsplit("/", 1)[0] for b in both for p in b.values()}
    assert len({p.rsplit("/", 1)[0] for p in now.values()}) == 1
    assert spark.read.parquet(now["first_icu_stay"]).count() == 15


def test_ids_beyond_32_bits(spark):
    from tidemark.sources.surrogate import surrogate_tables as derive
    root = tempfile.mkdtemp(prefix="tidemark-big-")
    for name in ("customer", "nation", "part"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{root}/{name}.parquet")
    spark.read.parquet(f"{SF}/events.parquet").selectExpr(
        "event_id + 3000000000 AS event_id", "ts", "user_id + 3000000000 AS user_id", "event_type", "value") \
        .write.parquet(f"{root}/events.parquet")
    t = derive(spark, root)
    assert t.procedureevents.agg({"orderid": "max"}).first()[0] > 3 * 10**9
    assert t.diagnoses_icd.agg({"seq_num": "min"}).first()[0] >= 3 * 10**9 and t.icustays.agg({"stay_id": "max"}).first()[0] > 3 * 10**10


def test_json_sink_keeps_nulls(spark):
    import json
    import os

    from tidemark.plans.sinks import write_json
    out = tempfile.mkdtemp(prefix="tidemark-json-") + "/rows"
    df = spark.createDataFrame([(1, None)], "a int, b double")
    write_json(df, out)
    lines = [ln for f in os.listdir(out) if f.endswith(".json") for ln in open(os.path.join(out, f))]
    assert [json.loads(ln) for ln in lines] == [{"a": 1, "b": None}]


def test_cli_refresh_from_stored_inputs(spark):
    import os

    from tidemark.__main__ import main
    from tidemark.schemas import INPUTS
    root = tempfile.mkdtemp(prefix="tidemark-cli-")
    t = surrogate_tables(spark, SF)
    for name in INPUTS:
        getattr(t, name).write.parquet(f"{root}/inputs/{name}")
    # a downstream table alone: its missing upstream profile is built first
    assert main(["refresh", "--inputs", f"{root}/inputs", "--out", f"{root}/a",
                 "--tables", "fisi9t_chemistry_hourly"]) == 0
    first = published(spark, f"{root}/a")
    assert os.path.exists(f"{first['fisi9t_unique_patient_profile']}/_SUCCESS")
    assert spark.read.parquet(first["fisi9t_chemistry_hourly"]).count() > 0
    assert main(["refresh", "--inputs", f"{root}/inputs", "--out", f"{root}/b"]) == 0
    assert all(os.path.exists(f"{p}/_SUCCESS") for p in published(spark, f"{root}/b").values())
    assert list(published(spark, f"{root}/b").keys() - set(ORDER)) == []


def test_tables_are_queryable_by_name(spark):
    from tidemark.plans.chain import build_tables, register_tables
    t = surrogate_tables(spark, SF).register()
    names = register_tables(build_tables(t))
    assert names == ORDER
    n = spark.sql("SELECT count(*) FROM fisi9t_unique_patient_profile").first()[0]
    assert n == 12
    assert spark.sql("SELECT count(*) FROM icustays").first()[0] == 45


def test_single_stay_filter_reaches_scan(spark):
    from tidemark.operators.snapshot import for_stay, vitals_timeline
    out = tempfile.mkdtemp(prefix="tidemark-stay-")
    paths = refresh(spark, surrogate_tables(spark, SF), out)
    one = for_stay(spark.read.parquet(paths["fisi9t_vitalsign_hourly"]), 1, 30000010)
    profile = spark.read.parquet(paths["fisi9t_unique_patient_profile"])
    text = plan_text(vitals_timeline(one, profile, 1, 1, 23))
    assert "EqualTo(stay_id,30000010)" in text and "EqualTo(subject_id,1)" in text
    assert "PartitionFilters: [isnotnull(chart_month" in text


def test_hours_do_not_depend_on_the_session_zone(spark):
    from tidemark.functions.time import micros_of, round_to_hour, trunc_hour
    from tidemark.operators.sessions import session_summary
    sql = "SELECT timestamp_ntz'2024-03-10 02:10:00.5' AS t UNION ALL SELECT timestamp_ntz'2024-03-10 01:40:00' " \
          "UNION ALL SELECT timestamp_ntz'2024-11-03 01:29:59.999999' UNION ALL SELECT timestamp_ntz'1969-12-31 23:59:59.5'"
    got = []
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            df = spark.sql(sql)
            hours = df.select("t", trunc_hour("t").alias("a"), round_to_hour("t").alias("b"), micros_of("t").alias("m"))
            got.append((sorted(map(tuple, hours.collect())),
                        sorted(map(tuple, session_summary(df.selectExpr("1 AS k", "t AS charttime"), ["k"]).collect()))))
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got[0] == got[1]
    by = {str(t): (str(a), str(b), m) for t, a, b, m in got[0][0]}
    assert by["2024-03-10 02:10:00.500000"][:2] == ("2024-03-10 02:00:00", "2024-03-10 02:00:00")
    assert by["2024-03-10 01:40:00"][1] == "2024-03-10 02:00:00" and by["1969-12-31 23:59:59.500000"][2] == -500000


def test_inputs_read_from_catalog_by_name(spark):
    from tidemark.operators.cohort import cohort_chain
    from tidemark.sources.tables import read_inputs
    surrogate_tables(spark, SF).register()  # the inputs as named tables of the session catalog
    t = read_inputs(spark)
    assert t.vitalsign.schema == surrogate_tables(spark, SF).vitalsign.schema
    assert cohort_chain(t)["fisi9t_unique_patient_profile"].count() == 12


def test_inputs_resolve_through_a_search_path(spark):
    import pytest as _pytest

    from tidemark.sources.tables import read_inputs, resolve_table
    t = surrogate_tables(spark, SF)
    for name in ("icustays", "vitalsign"):
        getattr(t, name).createOrReplaceGlobalTempView(name)
    assert resolve_table(spark, "icustays", ["no_such_db", "global_temp"]) == "global_temp.icustays"
    with _pytest.raises(LookupError):
        resolve_table(spark, "chemistry", ["no_such_db", "global_temp"])
    for name in ("d_icd_diagnoses", "diagnoses_icd", "age", "icustay_detail", "procedureevents", "d_items",
                 "chemistry", "coagulation"):
        getattr(t, name).createOrReplaceGlobalTempView(name)
    got = read_inputs(spark, search_path=["no_such_db", "global_temp"])
    assert got.icustays.count() == 45
