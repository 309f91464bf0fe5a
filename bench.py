"""Benchmark of the headline queries.

Runs each query at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]``: the first call (cold), then the median of ``$BENCH_RUNS``
(default 3) further calls (warm), each building its plan anew from the given tables
and fully materialised through the ``noop`` sink.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans.queries import queries  # noqa: E402
from tidemark.session import build_session  # noqa: E402

HEADLINE = ["first_stay", "icd9_only_diagnoses", "titled_diagnoses", "stay_profile", "unique_profile",
            "vitals_hourly", "procedures_hourly", "chemistry_hourly", "coagulation_hourly",
            "gap_sessions", "hourly_census", "vitals_timeline", "patient_page", "delta_vitals"]


def _run(fn, spark, sf_dir) -> float:
    t0 = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = build_session(f"local[{cpus}]", int(cpus))
    qs = queries()
    names = only or HEADLINE
    # cold: the first call of each query in this process, its plan and code generation included
    cold = {n: round(_run(qs[n], spark, sf_dir), 3) for n in names}
    warm = {n: round(statistics.median(_run(qs[n], spark, sf_dir) for _ in range(runs)), 3) for n in names}
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(warm.values()), 3),
                      "unit": "sec", "queries": warm, "cold": cold, "cold_sum": round(sum(cold.values()), 3),
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "cpus": int(cpus), "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
