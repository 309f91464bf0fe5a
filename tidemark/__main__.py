"""Command line: ``python -m tidemark refresh|readiness ...`` (run via spark-submit
on a cluster, or locally).

* ``refresh --inputs ROOT|--database DB|--search-path DB1,DB2 --out ROOT [--tables T ...]`` rebuilds the
  nine tables in dependency order (a table and everything after it).
* ``readiness --table NAME`` prints the readiness report as JSON and exits 0/1.
"""

from __future__ import annotations

import argparse
import json
import sys

from .plans.chain import ORDER, refresh
from .operators.quality import readiness
from .session import build_session
from .sources.tables import read_inputs


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemark")
    sub = p.add_subparsers(dest="cmd", required=True)
    r = sub.add_parser("refresh")
    src = r.add_mutually_exclusive_group(required=True)
    src.add_argument("--inputs", help="folder with one Parquet folder per input table")
    src.add_argument("--database", help="catalog database holding the input tables")
    src.add_argument("--search-path", help="comma-separated databases; each table from the first holding it")
    r.add_argument("--out", required=True, help="shared folder for the nine tables")
    r.add_argument("--tables", nargs="*", choices=ORDER)
    r.add_argument("--master")
    q = sub.add_parser("readiness")
    q.add_argument("--table", default="fisi9t_unique_patient_profile")
    q.add_argument("--master")
    a = p.parse_args(argv)

    spark = build_session(a.master)
    if a.cmd == "refresh":
        path = a.search_path.split(",") if a.search_path else None
        inputs = read_inputs(spark, root=a.inputs, database=a.database, search_path=path)
        print(json.dumps(refresh(spark, inputs, a.out, a.tables), indent=1))
        return 0
    rep = readiness(spark, a.table, ["subject_id", "stay_id", "anchor_age", "gender"])
    print(json.dumps(rep, default=str, indent=1))
    return 0 if rep["ok"] else 1


if __name__ == "__main__":
    sys.exit(main())
