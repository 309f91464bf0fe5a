
from __future__ import annotations

from pyspark.sql import functions as F

import __spark_entry__ as E
from compare_oracle import digest
from tidemark.plans.queries import Ctx

SF = "/root/testdata/sf0.001"


def test_grid_has_hours_plus_two_rows_per_stay(spark):
    c = Ctx(spark, SF)
    per_stay = c.grid.groupBy("stay_id").agg(F.count(F.lit(1)).alias("n"))
    want = c.window.select("stay_id", ((F.unix_seconds(F.col("end_hour").cast("timestamp"))
                                        - F.unix_seconds(F.col("start_hour").cast("timestamp"))) / 3600 + 2)
                           .cast("long").alias("want"))
    bad = per_stay.join(want, "stay_id").filter(F.col("n") != F.col("want")).count()
    assert bad == 0 and per_stay.count() > 0


def test_feature_tables_are_unique_per_stay_hour_and_cover_the_grid(spark):
    q = E.queries()
    grid = q["hour_grid"](spark, SF)
    n_grid = grid.count()
    for name in ("vitals_hourly", "chemistry_hourly", "coagulation_hourly"):
        df = q[name](spark, SF)
        assert df.count() == n_grid, name
        assert df.select("stay_id", "charttime_hour").distinct().count() == n_grid, name
        assert df.join(grid, ["subject_id", "stay_id", "charttime_hour"], "left_anti").count() == 0, name


def test_results_do_not_depend_on_partitioning(spark):
    q = E.queries()
    names = ["vitals_hourly", "procedures_hourly", "coagulation_hourly", "gap_sessions_lag", "hourly_census"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    digests = {}
    try:
        for parts in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            for n in names:
                df = q[n](spark, SF)
                digests.setdefault(n, set()).add(digest(df.columns, [tuple(r) for r in df.collect()]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(len(d) == 1 for d in digests.values()), digests


def test_census_total_equals_admitted(spark):
    q = E.queries()
    census = {r.hour: r for r in q["hourly_census"](spark, SF).collect()}
    assert sum(r.new_patients for r in census.values()) == census[23].total_admitted
    assert census[23].total_admitted == q["month_day_filter"](spark, SF).count()
