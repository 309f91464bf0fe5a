"""The nine-table chain as one lazy plan, and its refresh.

``build_tables`` returns every output as a lazy DataFrame; Catalyst optimises
each one as a whole, so filters and column pruning reach the input scans.

``refresh`` materialises them in dependency order, tables that do not need each other at the same time.
Each table is read back for the next one, and the stay windows, which all hourly tables start from, are
stored for their time, so nothing is computed twice (this also cuts lineage: a lost executor recomputes from
the stored table, not from the raw inputs).  Every table is written with a layout that serves its lookups (K3):
range-partitioned on ``stay_id`` and sorted by (stay_id, charttime_hour), so
Parquet min/max statistics skip files and row groups for stay and time filters;
the hourly tables are also split into calendar (month, day) directories for the
clock filters.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..operators import cohort as C
from ..operators import grid as G
from ..operators import hourly as H
from ..schemas import OUTPUTS
from ..sources.surrogate import ClinicalTables
from . import files

ORDER = ["first_icu_stay", "fis_icd9", "fis_icd9_titled", "fisi9t_profile",
         "fisi9t_unique_patient_profile", "fisi9t_vitalsign_hourly",
         "fisi9t_procedureevents_hourly", "fisi9t_chemistry_hourly", "fisi9t_coagulation_hourly"]

# Sort key of each stored table (the access paths of the lookups).
LAYOUT = {
    "first_icu_stay": ["subject_id"],
    "fis_icd9": ["subject_id", "seq_num", "icd_code"],
    "fis_icd9_titled": ["subject_id", "seq_num", "icd_code"],
    "fisi9t_profile": ["subject_id", "seq_num", "icd_code"],
    "fisi9t_unique_patient_profile": ["subject_id"],
    "fisi9t_vitalsign_hourly": ["stay_id", "charttime_hour"],
    "fisi9t_procedureevents_hourly": ["stay_id", "charttime_hour", "charttime", "itemid", "orderid"],
    "fisi9t_chemistry_hourly": ["stay_id", "charttime_hour"],
    "fisi9t_coagulation_hourly": ["stay_id", "charttime_hour"],
}


def hourly_tables(t: ClinicalTables, profile: DataFrame) -> dict[str, DataFrame]:
    """P6-P9 from a one-row-per-subject profile."""
    return _hourly(t, _window(t, profile))


def _window(t: ClinicalTables, profile: DataFrame) -> DataFrame:
    return G.stay_window(G.cohort_stays(profile), t.icustay_detail)


def _hourly(t: ClinicalTables, window: DataFrame) -> dict[str, DataFrame]:
    grid = G.hour_grid(window)
    return {
        "fisi9t_vitalsign_hourly": H.vitals_hourly(t.vitalsign, window, grid),
        "fisi9t_procedureevents_hourly": H.procedures_hourly(t.procedureevents, window, t.d_items),
        "fisi9t_chemistry_hourly": H.chemistry_hourly(t.chemistry, window),
        "fisi9t_coagulation_hourly": H.coagulation_hourly(t.coagulation, window),
    }


def build_tables(t: ClinicalTables) -> dict[str, DataFrame]:
    """All nine tables as lazy DataFrames over ``t``."""
    out = C.cohort_chain(t)
    out.update(_hourly(t, G.timed_window(C.timed_profile(t, out["fis_icd9_titled"]))))
    return out


def register_tables(tables: dict[str, DataFrame]) -> list[str]:
    """Expose the tables to ``spark.sql`` under their names (session temp views)."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return list(tables)


# Hourly tables are stored in calendar partitions of their hour, so the clock
# filters (month and day of any year) prune directories instead of scanning.
CALENDAR_TABLES = {"fisi9t_vitalsign_hourly", "fisi9t_procedureevents_hourly",
                   "fisi9t_chemistry_hourly", "fisi9t_coagulation_hourly"}
CALENDAR_COLUMNS = ["chart_month", "chart_day"]


def with_calendar(df: DataFrame) -> DataFrame:
    return df.withColumn("chart_month", F.month("charttime_hour")) \
             .withColumn("chart_day", F.dayofmonth("charttime_hour"))


#: Columns that hold a row of each table at most once, and are never null.
UNIQUE = {
    "first_icu_stay": ["subject_id"],
    "fisi9t_unique_patient_profile": ["subject_id"],
    "fisi9t_vitalsign_hourly": ["stay_id", "charttime_hour"],
    "fisi9t_chemistry_hourly": ["stay_id", "charttime_hour"],
    "fisi9t_coagulation_hourly": ["stay_id", "charttime_hour"],
}
#: Lookup columns that get a Bloom filter in every row group (where they are not dictionary coded as a whole; there the dictionary answers).
LOOKUPS = ["stay_id", "subject_id"]


class ConstraintError(ValueError):
    """A table that must not be published: repeated or missing keys."""


def write_table(df: DataFrame, path: str, sort_keys: list[str], fmt: str = "parquet",
                partition_by: list[str] | None = None, unique: list[str] | None = None) -> dict[str, int]:
    """Write ``df`` to the new folder ``path`` with a range-partitioned, sorted layout; returns counts of
    ``n_rows``, and of ``n_repeated`` rows and ``n_null`` keys of ``unique``, all taken while writing.

    The range partitioner samples its input first, so the result is stored once as it comes and
    the layout is made from the stored rows: the chain behind it runs only once.  With
    ``partition_by`` each task covers a contiguous range of the partition values, so it writes
    into few directories.  Equal keys lie side by side in one range, so the
    rows of a key are counted in a window on that layout, without another exchange or scan."""
    spark, parts, raw = df.sparkSession, partition_by or [], f"{path}.raw"
    df.write.parquet(raw)
    stored = spark.read.schema(df.schema).parquet(raw)
    laid_out = stored.repartitionByRange(*parts, *sort_keys).sortWithinPartitions(*parts, *sort_keys)
    seen = Observation(f"write-{uuid.uuid4().hex}")
    counts = [F.count(F.lit(1)).alias("n_rows")]
    if unique:
        if unique != sort_keys:
            raise ValueError("a table is sorted by its unique key")
        same = F.count(F.lit(1)).over(Window.partitionBy(*parts, *sort_keys))
        null = F.greatest(*[F.col(c).isNull().cast("int") for c in unique], F.lit(0))
        laid_out = laid_out.withColumn("_same", same)
        counts += [F.count_if(F.col("_same") > 1).alias("n_repeated"), F.sum(null).alias("n_null")]
    laid_out = laid_out.observe(seen, *counts).drop("_same")
    writer = laid_out.write.format(fmt)
    if fmt == "parquet":
        for c in LOOKUPS:
            if c in df.columns:
                writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
                if unique == [c]:  # a dictionary of distinct values helps nobody
                    writer = writer.option(f"parquet.enable.dictionary#{c}", "false")
        writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
    if parts:
        writer = writer.partitionBy(*parts)
    writer.save(path)
    files.delete(spark, raw)
    return {k: int(v or 0) for k, v in seen.get.items()}


PROFILE = "fisi9t_unique_patient_profile"
# What each table is computed from.
DEPENDS = {
    "first_icu_stay": [], "fis_icd9": ["first_icu_stay"], "fis_icd9_titled": ["fis_icd9"],
    "fisi9t_profile": ["fis_icd9_titled"], "fisi9t_unique_patient_profile": ["fisi9t_profile"],
    **{n: [PROFILE] for n in ORDER[5:]},
}


def with_dependents(tables) -> list[str]:
    """The tables and all that are computed from them, in order (the CASCADE of a view drop)."""
    out = set(tables)
    for name in ORDER:
        if out & set(DEPENDS[name]):
            out.add(name)
    return [n for n in ORDER if n in out]


MANIFEST = "table string, path string, version long"
#: Seconds for which a refresh or reader holds its folders unless it lets go or asks for more.
LEASE_SECONDS = 24 * 3600


def published(spark: SparkSession, out_root: str) -> dict[str, str]:
    """The newest published folder of each table under ``out_root``; dropped tables have none."""
    path = f"{out_root}/manifest"
    if not files.exists(spark, path):
        return {}
    rows = spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(path)
    newest = rows.groupBy("table").agg(F.max_by("path", "version").alias("path")).where("path IS NOT NULL")
    return {r["table"]: r["path"] for r in newest.collect()}


def _publish(spark: SparkSession, out_root: str, rows: list[tuple[str, str | None, int]], name: str) -> None:
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{out_root}/manifest/{name}")


def refresh(spark: SparkSession, t: ClinicalTables, out_root: str,
            tables: list[str] | None = None, fmt: str = "parquet", checks: dict[str, dict[str, int]] | None = None) -> dict[str, str]:
    """Rebuild ``tables`` (all by default), what depends on them, and inputs of theirs that were
    never published, in dependency order under ``out_root`` (a shared folder).

    Every refresh writes into a folder of its own and every table starts from the stored table
    before it.  All are published together at the end, by one file in the manifest: a failed
    refresh publishes nothing, readers keep the folders that they opened, and of two
    writers the later one is what ``published`` returns, whole.

    A table whose unique key (``UNIQUE``) is repeated or null, by the counts taken in its write, stops the
    refresh with ``ConstraintError``, once the tables written beside it have ended.  ``checks`` receives the counts of each table.
    """
    have = published(spark, out_root)
    todo = set(with_dependents(tables or ORDER))
    for name in reversed(ORDER):
        if name in todo:
            todo |= {d for d in DEPENDS[name] if d not in have}
    version = time.time_ns()
    folder = f"{out_root}/versions/{version}-{uuid.uuid4().hex}"
    lease = hold(spark, out_root, [folder, *{have[d].rsplit("/", 1)[0] for n in todo for d in DEPENDS[n] if d in have}])
    paths = {n: f"{folder}/{n}" for n in ORDER if n in todo}
    windows = f"{folder}/stay_window.raw"

    def stored(name: str) -> DataFrame:
        return spark.read.format(fmt).load(paths.get(name, have.get(name))).select(*OUTPUTS[name])

    def build(name: str) -> dict[str, int]:
        calendar = name in CALENDAR_TABLES
        out = _hourly(t, spark.read.parquet(windows))[name] if calendar else _table(name, t, *map(stored, DEPENDS[name]))
        out = out.select(*OUTPUTS[name])
        counts = write_table(with_calendar(out) if calendar else out, paths[name], LAYOUT[name], fmt,
                             CALENDAR_COLUMNS if calendar else None, UNIQUE.get(name))
        if counts.get("n_repeated") or counts.get("n_null"):
            raise ConstraintError(f"{name}: {counts['n_repeated']} rows repeat their {UNIQUE[name]}, {counts['n_null']} have none")
        return counts

    try:
        left = list(paths)
        while left:
            ready = [n for n in left if not set(DEPENDS[n]) & set(left)]
            left = [n for n in left if n not in ready]
            if CALENDAR_TABLES & set(ready):
                _window(t, stored(PROFILE)).write.parquet(windows)
            for name, counts in zip(ready, _at_once(spark, build, ready)):
                if checks is not None:
                    checks[name] = counts
        files.delete(spark, windows)
        _publish(spark, out_root, [(n, p, version) for n, p in paths.items()], os.path.basename(folder))
    except BaseException:
        files.delete(spark, folder)
        raise
    finally:
        release(spark, out_root, lease)
    return paths


def _at_once(spark: SparkSession, build: Callable[[str], dict[str, int]], tables: list[str]) -> list[dict[str, int]]:
    """``build`` of each table, all jobs under the caller's job group.  All have ended when it returns or raises."""
    if len(tables) == 1:
        return [build(tables[0])]
    with ThreadPoolExecutor(len(tables)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(build), n) for n in tables]]


def drop(spark: SparkSession, out_root: str, tables: list[str], cascade: bool = True) -> list[str]:
    """Unpublish ``tables`` and what was computed from them, in one step; returns their names.

    Without ``cascade``, tables that others depend on are refused.  Tables that are not published are passed
    over.  Files stay until ``vacuum``, so readers of a dropped table finish."""
    have = published(spark, out_root)
    gone = [n for n in with_dependents(tables) if n in have]
    others = [n for n in gone if n not in tables]
    if others and not cascade:
        raise ValueError(f"{', '.join(others)} depend on {', '.join(tables)}")
    if gone:
        version = time.time_ns()
        _publish(spark, out_root, [(n, None, version) for n in gone], f"{version}-{uuid.uuid4().hex}-drop")
    return gone


def hold(spark: SparkSession, out_root: str, folders: list[str], seconds: int = LEASE_SECONDS) -> list[str]:
    """Keep version folders from ``vacuum`` until ``release``, or until the time is over (of a holder that was lost)."""
    until, token = int(time.time()) + seconds, uuid.uuid4().hex
    lease = [f"{until}.{os.path.basename(f)}.{token}" for f in folders]
    for name in lease:
        files.touch(spark, f"{out_root}/leases/{name}")
    return lease


def release(spark: SparkSession, out_root: str, lease: list[str]) -> None:
    for name in lease:
        files.delete(spark, f"{out_root}/leases/{name}")


@contextmanager
def reading(spark: SparkSession, out_root: str, seconds: int = LEASE_SECONDS) -> Iterator[dict[str, str]]:
    """The published folders, held while they are read."""
    while True:
        have = published(spark, out_root)
        lease = hold(spark, out_root, sorted({p.rsplit("/", 1)[0] for p in have.values()}), seconds)
        if all(files.exists(spark, p) for p in have.values()):  # none was removed in between
            break
        release(spark, out_root, lease)
    try:
        yield have
    finally:
        release(spark, out_root, lease)


def vacuum(spark: SparkSession, out_root: str) -> list[str]:
    """Delete table folders that no published name refers to and nobody holds; returns them.

    Leases are listed first and publications after: a refresh holds its folder from before its first
    write until it is published, so the folder is seen by one of the two."""
    now = time.time()
    held, ended = set(), []
    listed = files.names(spark, f"{out_root}/versions")
    for name in files.names(spark, f"{out_root}/leases"):
        until, folder, _ = name.split(".")
        (held.add(folder) if int(until) >= now else ended.append(name))
    kept = set(published(spark, out_root).values())
    gone = []
    for version in listed:
        if version in held:
            continue
        tables = [f"{out_root}/versions/{version}/{t}" for t in files.names(spark, f"{out_root}/versions/{version}")]
        old = [t for t in tables if t not in kept]
        for path in old if len(old) < len(tables) else [f"{out_root}/versions/{version}"]:
            files.delete(spark, path)
        gone += old
    release(spark, out_root, ended)
    return gone


def _table(name: str, t: ClinicalTables, before: DataFrame | None = None) -> DataFrame:
    """One table of the cohort chain from the stored table before it."""
    if name == "first_icu_stay":
        return C.first_stay(t.icustays)
    if name == "fis_icd9":
        return C.icd9_only_diagnoses(before, t.diagnoses_icd)
    if name == "fis_icd9_titled":
        return C.titled_diagnoses(before, t.d_icd_diagnoses)
    if name == "fisi9t_profile":
        return C.stay_profile(before, t.age, t.icustay_detail)
    return C.unique_profile(before)
