"""Run every registered query and its DuckDB oracle and compare them the way the
driver does: row count, column names, and an order-insensitive hash of values
(columns sorted by name, floats rounded)."""

from __future__ import annotations

import hashlib
import math
import sys
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

import __spark_entry__ as E  # noqa: E402
from tidemark.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{round(v, 6):.6f}"
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, Decimal):
        return f"{float(v):.6f}"
    return str(v)


SPARK_TO_DUCKDB = {"int": "INTEGER", "bigint": "BIGINT", "smallint": "SMALLINT", "double": "DOUBLE",
                   "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
                   "date": "DATE", "float": "FLOAT"}


def spark_types(df) -> dict[str, str]:
    return {f.name: SPARK_TO_DUCKDB.get(f.dataType.simpleString(), f.dataType.simpleString().upper())
            for f in df.schema.fields}


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16]


def main(sf_dir="/root/testdata/sf0.01", only=None):
    spark = build_session("local[8]", 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    qs, sql = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t0 = time.time()
        df = fn(spark, sf_dir)
        rows = [tuple(r) for r in df.collect()]
        cols = df.columns
        ts = time.time() - t0
        if name not in sql:
            print(f"{name:28s} spark={len(rows):7d} (no oracle) {ts:.1f}s")
            continue
        res = con.execute(sql[name])
        ocols = [d[0] for d in res.description]
        orows = res.fetchall()
        ok = (len(rows) == len(orows) and sorted(cols) == sorted(ocols)
              and digest(cols, rows) == digest(ocols, orows))
        bad += not ok
        print(f"{name:28s} spark={len(rows):7d} oracle={len(orows):7d} {'OK ' if ok else 'BAD'} {ts:.1f}s"
              + ("" if sorted(cols) == sorted(ocols) else f" cols {sorted(set(cols) ^ set(ocols))}"))
    print("mismatches:", bad)
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = args[0] if args else "/root/testdata/sf0.01"
    sys.exit(1 if main(sf, set(args[1:]) or None) else 0)
