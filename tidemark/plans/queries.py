"""Registered queries: one per operator of the inventory, each ``(spark, sf_dir)``.

Every query reads the whole given tables through the surrogate mapping and runs
the library operators on them, in one plan that is new on each call: nothing is stored,
so the read-side queries (P10-P21) compute the tables they show from the given ones too.
The ``STORED`` queries alone write tables first, in a folder of their own, and read them back.  The parameters below are the workload constants:
the clock day is a parameter because the test data covers January only (the
reference's own constant is March 13).  Means are rounded to 6 decimals, the
comparison protocol with the oracle (float sums differ in the last digits with
summation order).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import display as D
from ..functions.json import json_fields
from ..functions.time import display_clock, round_to_hour
from ..operators import browse as B
from ..operators import cohort as C
from ..operators import grid as G
from ..operators import hourly as H
from ..operators import quality as Q
from ..operators import selection as S
from ..operators import sessions as SS
from ..operators import snapshot as P
from ..schemas import OUTPUTS, VITAL_MEANS
from ..sources.surrogate import ClinicalTables, surrogate_tables
from ..session import checkpoint_dir
from . import stored as K
from .chain import CALENDAR_COLUMNS, LAYOUT, UNIQUE, drop, published, refresh, vacuum, with_calendar, write_table
from .sinks import write_json

# Workload parameters of the registered queries (fixed values).
CLOCK_MONTH = 1
CLOCK_DAY = 1
CLOCK_HOUR = 16
PAGE = 2
SEARCH = "14 2"
INDEXED_SEARCH = "0010 200 3"
BUCKETS = 8
#: Columns that the readiness check looks for.
REQUIRED = {"first_icu_stay": ["subject_id", "stay_id", "intime"],
            "fisi9t_unique_patient_profile": ["subject_id", "stay_id", "anchor_age", "gender"],
            "fisi9t_vitalsign_hourly": ["stay_id", "charttime_hour"]}
BROWSE_GENDER = "F"
TRIPLE_SEGMENTS = ("BUILDING", "MACHINERY")
SUBJECT_SEGMENTS = ("AUTOMOBILE",)
DIGITS = 6
# the published temperature is a decimal and needs no rounding for the comparison
HOURLY_MEANS = [c for c in VITAL_MEANS if c != "temperature"]

KEYS = ["subject_id", "stay_id"]


def _round(df: DataFrame, cols) -> DataFrame:
    return df.select(*[F.round(F.col(c), DIGITS).alias(c) if c in cols else F.col(c) for c in df.columns])


class Ctx:
    """Building blocks shared by the plan of one query call: lazy plans over the given tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def t(self) -> ClinicalTables:
        """The clinical inputs, derived from the given tables in the same plan."""
        return surrogate_tables(self.spark, self.sf_dir)

    # P1-P5, each built when it is asked for

    @cached_property
    def first(self) -> DataFrame:
        return C.first_stay(self.t.icustays)

    @cached_property
    def coded(self) -> DataFrame:
        return C.icd9_only_diagnoses(self.first, self.t.diagnoses_icd)

    @cached_property
    def titled(self) -> DataFrame:
        return C.titled_diagnoses(self.coded, self.t.d_icd_diagnoses)

    @cached_property
    def profile(self) -> DataFrame:
        return C.unique_profile(C.stay_profile(self.titled, self.t.age, self.t.icustay_detail))

    @cached_property
    def timed(self) -> DataFrame:
        """The profile with the stay's times."""
        return C.timed_profile(self.t, self.titled)

    @cached_property
    def window(self) -> DataFrame:
        return G.timed_window(self.timed)

    @cached_property
    def grid(self) -> DataFrame:
        return G.hour_grid(self.window)

    @cached_property
    def vitals_hourly(self) -> DataFrame:
        return self._vitals(self.window, self.grid)

    def _vitals(self, window: DataFrame, grid: DataFrame) -> DataFrame:
        return _round(H.vitals_hourly(self.t.vitalsign, window, grid), HOURLY_MEANS)

    @cached_property
    def procedures_hourly(self) -> DataFrame:
        return H.procedures_hourly(self.t.procedureevents, self.window, self.t.d_items)

    @cached_property
    def window_on_day(self) -> DataFrame:
        """Windows of the stays that have grid hours on the clock day."""
        return G.on_calendar_day(self.window, CLOCK_MONTH, CLOCK_DAY)

    @cached_property
    def vitals_on_day(self) -> DataFrame:
        """The hourly vitals of the clock day: only stays of that day are read into clusters."""
        return self._vitals(self.window_on_day, G.hour_grid(self.window_on_day, CLOCK_MONTH, CLOCK_DAY))

    @cached_property
    def procedures_on_day(self) -> DataFrame:
        return self._procedures(self.window_on_day)

    def _procedures(self, window: DataFrame) -> DataFrame:
        """The procedure rows of the clock day."""
        grid = G.hour_grid(window, CLOCK_MONTH, CLOCK_DAY, bounds=True)
        return H.procedures_hourly(self.t.procedureevents, window, self.t.d_items, grid)

    @cached_property
    def admitted_window(self) -> DataFrame:
        """Windows of the stays admitted on the clock day by the clock hour."""
        return G.timed_window(S.admitted_as_of(S.admitted_on(self.timed, CLOCK_MONTH, CLOCK_DAY), CLOCK_HOUR))

    def admitted_vitals(self, window: DataFrame) -> DataFrame:
        """The vitals of these stays on the clock day."""
        return self._vitals(window, G.hour_grid(window, CLOCK_MONTH, CLOCK_DAY))

    @cached_property
    def on_day(self) -> DataFrame:
        return S.admitted_on(self.profile, CLOCK_MONTH, CLOCK_DAY)

    def cohort_day(self, profile: DataFrame) -> DataFrame:
        """The cohort of the triples, admitted on the clock's month and day."""
        return S.base_patients(profile, ("triples", self.cohort_triples()), CLOCK_MONTH, CLOCK_DAY)

    @cached_property
    def _customer(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/customer.parquet")

    def cohort_triples(self) -> DataFrame:
        cust = (self._customer.filter(F.col("c_mktsegment").isin(*TRIPLE_SEGMENTS))
                .select(F.col("c_custkey").cast("long").alias("subject_id")))
        return self.t.icustays.join(cust, "subject_id", "left_semi").select(*S.TRIPLE)

    def cohort_subject_ids(self) -> DataFrame:
        return (self._customer.filter(F.col("c_mktsegment").isin(*SUBJECT_SEGMENTS))
                .select(F.col("c_custkey").cast("long").alias("subject_id")))


def _timeline(c: Ctx) -> DataFrame:
    return P.vitals_timeline(c.vitals_on_day, None, CLOCK_MONTH, CLOCK_DAY, CLOCK_HOUR)


def _new_root(c: Ctx, kind: str) -> str:
    return f"{checkpoint_dir(c.spark)}/tidemark-{kind}-{uuid.uuid4().hex}"


def _store(c: Ctx, root: str, name: str, df: DataFrame) -> str:
    """``df`` written in the layout of table ``name``; its folder."""
    calendar = name in ("fisi9t_vitalsign_hourly",)
    write_table(with_calendar(df) if calendar else df, f"{root}/{name}", LAYOUT[name],
                partition_by=CALENDAR_COLUMNS if calendar else None, unique=UNIQUE.get(name))
    return f"{root}/{name}"


def _drop_cascade(c: Ctx) -> DataFrame:
    """All nine tables, less a dropped one and what depends on it: what is left, read from its folders."""
    root = _new_root(c, "drop")
    refresh(c.spark, c.t, root)
    drop(c.spark, root, ["fisi9t_profile"])
    vacuum(c.spark, root)
    counts = [c.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), "n_rows")
              for name, path in sorted(published(c.spark, root).items())]
    out = counts[0]
    for df in counts[1:]:
        out = out.unionByName(df)
    return out


def _publish_checks(c: Ctx) -> DataFrame:
    """The counts that a refresh took while it wrote each table."""
    checks: dict[str, dict[str, int]] = {}
    refresh(c.spark, c.t, _new_root(c, "checks"), checks=checks)
    rows = [(n, k["n_rows"], k.get("n_repeated", 0), k.get("n_null", 0)) for n, k in checks.items()]
    return c.spark.createDataFrame(rows, "table string, n_rows long, n_repeated long, n_null long")


def _stored_lookup(c: Ctx) -> DataFrame:
    return P.patient_lookup(c.spark.read.parquet(_store(c, _new_root(c, "lookup"), "fisi9t_unique_patient_profile", c.profile)), c.cohort_triples())


def _stored_page(c: Ctx) -> DataFrame:
    """The last page of the stored profile, asked for by a number beyond it."""
    path = _store(c, _new_root(c, "page"), "fisi9t_unique_patient_profile", c.profile)
    return P.patient_page(c.spark.read.parquet(path), 10**9)


def _bucketed(c: Ctx) -> DataFrame:
    rows = H.vitals_hourly(c.t.vitalsign, c.window, c.grid)
    out = K.bucketed_on_grid(c.spark, c.grid, rows, _new_root(c, "buckets"), BUCKETS)
    return _round(out.select(*OUTPUTS["fisi9t_vitalsign_hourly"]), HOURLY_MEANS)


def _ticks(c: Ctx) -> DataFrame:
    """Every hour of every day of the clock's month on which a patient was admitted."""
    root = _new_root(c, "ticks")
    profile = c.spark.read.parquet(_store(c, root, "fisi9t_unique_patient_profile", c.profile))
    vitals = c.spark.read.parquet(_store(c, root, "fisi9t_vitalsign_hourly", c.vitals_hourly))
    days = profile.where(F.month("intime") == CLOCK_MONTH).select(F.month("intime").alias("tick_month"), F.dayofmonth("intime").alias("tick_day")).distinct()
    ticks = days.withColumn("tick_hour", F.explode(F.sequence(F.lit(0), F.lit(P.CLOCK_HOURS - 1))))
    return P.delta_vitals_at_ticks(vitals, profile, ticks)


def _indexed_search(c: Ctx) -> DataFrame:
    root = _new_root(c, "grams")
    profile = c.spark.read.parquet(_store(c, root, "fisi9t_unique_patient_profile", c.profile))
    write_table(B.id_grams(profile), f"{root}/grams", ["gram", *B.SEARCH_FIELDS])
    return B.id_search_indexed(profile, c.spark.read.parquet(f"{root}/grams"), INDEXED_SEARCH)


def _order_check(c: Ctx) -> DataFrame:
    name = "fisi9t_vitalsign_hourly"
    return K.order_check(c.spark, _store(c, _new_root(c, "order"), name, c.vitals_hourly), LAYOUT[name], CALENDAR_COLUMNS)


def _readiness(c: Ctx) -> DataFrame:
    root = _new_root(c, "ready")
    have = {n: _store(c, root, n, df) for n, df in (("first_icu_stay", c.first), ("fisi9t_unique_patient_profile", c.profile))}
    return K.readiness_report(c.spark, have, REQUIRED)


def _clock_response(c: Ctx) -> DataFrame:
    vitals = P.delta_vitals(c.admitted_vitals(c.admitted_window), None, CLOCK_MONTH, CLOCK_DAY, CLOCK_HOUR)
    procedures = P.delta_procedures(c._procedures(c.admitted_window), None, CLOCK_MONTH, CLOCK_DAY, CLOCK_HOUR)
    shown = display_clock(F.lit(CLOCK_HOUR), F.lit(f"2025-{CLOCK_MONTH:02d}-{CLOCK_DAY:02d}"))
    return P.clock_response(c.on_day, vitals, procedures, CLOCK_HOUR, shown)


def _json_sink(c: Ctx) -> DataFrame:
    """The timeline rows as JSON lines, read back as text."""
    path = _new_root(c, "json")
    rows = _timeline(c)
    write_json(rows.select(json_fields(rows, [*P.TIMELINE_COLUMNS, "hour_label"]).alias("r")).select("r.*"), path)
    return c.spark.read.text(path).withColumnRenamed("value", "json")


def _keys(c: Ctx) -> DataFrame:
    """Profile rows per composite key."""
    return c.profile.groupBy(D.composite_key().alias("k")).agg(F.count(F.lit(1)).alias("n_rows")) \
        .select(F.concat_ws("/", "k.subject_id", "k.stay_id", "k.hadm_id").alias("composite_key"), "n_rows")


def _census(c: Ctx) -> DataFrame:
    """Vitals rows are the grid's; of the procedure rows only their hours count.  A tick counts stays admitted that day."""
    admitted = S.admitted_on(c.timed, CLOCK_MONTH, CLOCK_DAY)
    window = G.timed_window(admitted)
    grid = G.hour_grid(window, CLOCK_MONTH, CLOCK_DAY, bounds=True)
    events = H.events_on_grid(c.t.procedureevents, window, grid)
    return P.hourly_census(c.spark, admitted, grid, events, CLOCK_MONTH, CLOCK_DAY)


def _all_vitals(c: Ctx) -> DataFrame:
    return c.t.vitalsign.select(*KEYS, "charttime")


REGISTRY: dict[str, Callable[[Ctx], DataFrame]] = {
    "first_stay": lambda c: c.first,
    "icd9_only_diagnoses": lambda c: c.coded,
    "titled_diagnoses": lambda c: c.titled,
    "stay_profile": lambda c: C.stay_profile(c.titled, c.t.age, c.t.icustay_detail),
    "unique_profile": lambda c: c.profile,
    "unique_subject_check": lambda c: Q.uniqueness_report(c.profile),
    "stay_window": lambda c: c.window,
    "hour_grid": lambda c: c.grid,
    "round_to_hour": lambda c: c.t.vitalsign.select(*KEYS, "charttime",
                                                    round_to_hour("charttime").alias("charttime_hour")),
    "gap_sessions": lambda c: SS.session_summary(_all_vitals(c), KEYS),
    "gap_sessions_lag": lambda c: SS.gap_sessions(_all_vitals(c), KEYS)
    .select(*KEYS, "charttime", "cluster_id", "cluster_time"),
    "session_means": lambda c: _round(H.vital_clusters(c.t.vitalsign, c.window), VITAL_MEANS),
    "first_non_null": lambda c: H.reduce_hourly(
        c.t.vitalsign.withColumn("charttime_hour", round_to_hour("charttime")),
        {"temperature_site": "first"}, time_col="charttime"),
    "last_non_null": lambda c: H.reduce_hourly(
        H.labs_in_stay(c.t.coagulation, c.window, ["inr", "pt", "ptt", "thrombin"]),
        {"inr": "last", "pt": "last", "ptt": "last", "thrombin": "last"}, time_col="charttime"),
    "vitals_hourly": lambda c: c.vitals_hourly,
    "procedures_hourly": lambda c: c.procedures_hourly,
    "chemistry_hourly": lambda c: _round(H.chemistry_hourly(c.t.chemistry, c.window),
                                         ["calcium", "sodium"]),
    "coagulation_hourly": lambda c: H.coagulation_hourly(c.t.coagulation, c.window),
    "events_in_stay_range_join": lambda c: H.labs_in_stay(c.t.chemistry, c.window,
                                                          ["bicarbonate", "calcium", "sodium", "potassium"]),
    "cohort_triples": lambda c: S.select_cohort(c.profile, triples=c.cohort_triples()),
    "cohort_subjects": lambda c: S.select_cohort(c.profile, subject_ids=c.cohort_subject_ids()),
    "month_day_filter": lambda c: c.on_day,
    "admitted_as_of": lambda c: S.admitted_as_of(c.on_day, CLOCK_HOUR),
    "patient_page": lambda c: P.patient_page(S.admitted_as_of(c.on_day, CLOCK_HOUR), PAGE),
    "patient_lookup": lambda c: P.patient_lookup(c.profile, c.cohort_triples()),
    "vitals_timeline": lambda c: _timeline(c),
    "vitals_timeline_json": lambda c: P.vitals_timeline_json(_timeline(c)),
    "vitals_timeline_page": lambda c: P.vitals_timeline_arrays(_timeline(c)),
    "procedure_log": lambda c: P.procedure_log(c.procedures_on_day, None, CLOCK_MONTH, CLOCK_DAY, CLOCK_HOUR),
    "delta_new_patients": lambda c: P.delta_new_patients(c.on_day, CLOCK_HOUR),
    "delta_vitals": lambda c: P.delta_vitals(c.admitted_vitals(c.admitted_window), None, CLOCK_MONTH, CLOCK_DAY, CLOCK_HOUR),
    "delta_procedures": lambda c: P.delta_procedures(c._procedures(c.admitted_window), None, CLOCK_MONTH,
                                                     CLOCK_DAY, CLOCK_HOUR),
    "hourly_census": lambda c: _census(c),
    "facet_counts": lambda c: B.facet_counts(c.profile),
    "browse_rows": lambda c: B.browse_rows(c.profile, {"gender": BROWSE_GENDER}),
    "session_window_clusters": lambda c: SS.gap_sessions_window(_all_vitals(c), KEYS),
    "id_search": lambda c: B.id_search(c.profile, SEARCH),
    "display_rows": lambda c: D.patient_rows(c.profile),
    "procedure_display": lambda c: D.procedure_rows(P.procedure_log(
        c.procedures_on_day, None, CLOCK_MONTH, CLOCK_DAY, CLOCK_HOUR)),
    "sample_and_count": lambda c: Q.sample_and_count(c.profile),
    "clock_cohort_list": lambda c: S.admitted_as_of(c.cohort_day(c.profile), CLOCK_HOUR),
    "clock_cohort_delta": lambda c: P.delta_vitals(c.admitted_vitals(G.timed_window(
        S.admitted_as_of(c.cohort_day(c.timed), CLOCK_HOUR))), None, CLOCK_MONTH, CLOCK_DAY, CLOCK_HOUR),
    "clock_not_started": lambda c: S.clock_state(c.on_day, -1),
    "detail_header": lambda c: D.detail_header(c.profile),
    "vital_labels": lambda c: D.vital_labels(c.vitals_hourly),
    "procedure_labels": lambda c: D.procedure_labels(c.procedures_hourly),
    "drop_cascade": _drop_cascade,
    "publish_checks": _publish_checks,
    "stored_lookup": _stored_lookup,
    "stored_page": _stored_page,
    "bucketed_grid_join": _bucketed,
    "delta_vitals_ticks": _ticks,
    "id_search_indexed": _indexed_search,
    "stored_order_check": _order_check,
    "readiness": _readiness,
    "clock_response": _clock_response,
    "timeline_json_sink": _json_sink,
    "composite_keys": _keys,
    "stored_vitals": lambda c: _round(c.spark.read.parquet(refresh(
        c.spark, c.t, f"{checkpoint_dir(c.spark)}/tidemark-refresh-{uuid.uuid4().hex}",
        ["fisi9t_vitalsign_hourly"])["fisi9t_vitalsign_hourly"]).select(*OUTPUTS["fisi9t_vitalsign_hourly"]), HOURLY_MEANS),
}


#: Queries that write tables before they read them.
STORED = {"drop_cascade", "publish_checks", "stored_lookup", "stored_page", "bucketed_grid_join", "delta_vitals_ticks", "id_search_indexed",
          "stored_order_check", "readiness", "timeline_json_sink", "stored_vitals"}


def make_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """The registered query ``name``: a new plan over the given tables on each call."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return REGISTRY[name](Ctx(spark, sf_dir))
    run.__name__ = name
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: make_query(name) for name in REGISTRY}
