"""Hourly feature tables on the dense grid.

Readings (or cluster summaries) are rounded half-up to the hour and each column
collapses with its policy (mean/min/max/first/last, see ``functions.aggregates``)
onto the dense grid.  Labs are reduced per subject and hour before any exchange and then
meet the stay windows in a join binned by hour; ``reduce_hourly`` + ``on_grid`` reduce first and join the
grid 1:1 (vitals, whose clusters are already partitioned by stay).

* P6 vitals: gap clusters first (mean per cluster, first site by time), then the
  cluster means are averaged per hour of the cluster's *first* reading.
  Vitals are not bounded by the stay window; the grid join alone drops them.
* P7 procedures: not reduced.  Events inside the stay window, each on its own
  row, plus one all-NULL row for every grid hour without events, in one join binned by hour.
* P8 chemistry / P9 coagulation: readings inside the stay window (matched on the
  subject alone), reduced per hour with fixed policies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import merge_agg, policy_agg, state_aggs
from ..functions.time import round_to_hour
from ..schemas import OUTPUTS, VITAL_COLUMNS, VITAL_MEANS
from .grid import hour_grid
from .key_filter import as_id, key_filter, may_hold
from .sessions import bucket_of, bucket_sessions

KEYS = ["subject_id", "stay_id"]

# Fixed policies of the published tables.
VITAL_POLICIES = {**{c: "mean" for c in VITAL_MEANS}, "temperature_site": "first"}
CHEMISTRY_POLICIES = {"bicarbonate": "min", "calcium": "mean", "sodium": "mean", "potassium": "max"}
COAGULATION_POLICIES = {"inr": "last", "pt": "last", "ptt": "last", "thrombin": "last",
                        "d_dimer": "max", "fibrinogen": "min"}


def reduce_hourly(df: DataFrame, policies: dict[str, str], time_col: str,
                  hour_col: str = "charttime_hour", keys: list[str] = KEYS) -> DataFrame:
    """Group by (keys, hour) and apply one policy per column."""
    aggs = [policy_agg(c, p, order=time_col) for c, p in policies.items()]
    return df.groupBy(*keys, hour_col).agg(*aggs)


def on_grid(grid: DataFrame, hourly: DataFrame, columns: list[str]) -> DataFrame:
    """Grid LEFT JOIN hourly on (subject, stay, hour).  Subject is functionally
    dependent on stay; keeping it in the key lets both sides share the
    partitioning of the hourly aggregate."""
    keys = KEYS + ["charttime_hour"]
    return grid.join(hourly.select(*keys, *columns), keys, "left").select(*keys, *columns)


def in_stay_window(events: DataFrame, window: DataFrame, time_col: str, on: list[str]) -> DataFrame:
    """Range join (J11/J12): events x stay window on ``on`` with the closed range
    ``icu_intime <= time <= icu_outtime``.  The window table holds one row per
    cohort stay; the residual range is evaluated inside the equi join."""
    w = window.select(*dict.fromkeys(["subject_id", "stay_id", *on]), "icu_intime", "icu_outtime")
    t = F.col(time_col)
    joined = events.filter(t.isNotNull()).join(w, on)
    return joined.filter((t >= F.col("icu_intime")) & (t <= F.col("icu_outtime"))) \
                 .drop("icu_intime", "icu_outtime")


# --- P6 -----------------------------------------------------------------------

def vital_clusters(vitals: DataFrame, cohort: DataFrame) -> DataFrame:
    """One row per gap cluster: mean of every vital, first non-NULL site, and the
    hour of the cluster's first reading (``charttime_hour``).

    One scan of the readings: they are summed per (stay, bucket, site), a hash aggregate
    with partial aggregation before any exchange, so a stay with most of the readings
    leaves each map task as its bucket rows.  Those rows are cut to the cohort and merged
    per bucket (first site by time).  Clusters are runs of
    buckets: their means are sums over the run divided by counts, and both the
    cluster and the hour reduction run on the stay partitioning of the bucket
    window, without another exchange.
    """
    v = vitals.select(*KEYS, "charttime", *VITAL_POLICIES).filter(F.col("charttime").isNotNull())
    v = v.withColumn("temperature", F.col("temperature").cast("double")).withColumn("_bucket", bucket_of("charttime"))
    sums = []
    for c in VITAL_MEANS:
        sums += [F.sum(c).alias(f"_s_{c}"), F.count(c).alias(f"_n_{c}")]
    parts = (v.groupBy(*KEYS, "_bucket", "temperature_site")
             .agg(F.min("charttime").alias("_t_first"), F.max("charttime").alias("_t_last"), *sums)
             .join(cohort.select(*KEYS), KEYS, "left_semi"))
    site = F.when(F.col("temperature_site").isNotNull(),
                  F.struct(F.col("_t_first").alias("t"), F.col("temperature_site").alias("v")))
    merged = [F.sum(f"_{k}_{c}").alias(f"_{k}_{c}") for c in VITAL_MEANS for k in "sn"]
    buckets = parts.groupBy(*KEYS, "_bucket").agg(F.min("_t_first").alias("_t_first"), F.max("_t_last").alias("_t_last"),
                                                  F.min(site).alias("_site"), *merged)
    b = bucket_sessions(buckets, KEYS)
    cluster_keys = ["cluster_id", "cluster_time"]
    merged = [(F.sum(f"_s_{c}") / F.sum(f"_n_{c}")).alias(c) for c in VITAL_MEANS]
    out = b.groupBy(*KEYS, *cluster_keys).agg(*merged, F.min("_site")["v"].alias("temperature_site"))
    return out.select(*KEYS, *cluster_keys, *VITAL_COLUMNS,
                      round_to_hour("cluster_time").alias("charttime_hour"))


def vitals_hourly(vitals: DataFrame, cohort: DataFrame, grid: DataFrame) -> DataFrame:
    """Vitals on the grid, the mean of cluster means per hour of the cluster's first reading."""
    clusters = vital_clusters(vitals, cohort)
    hourly = reduce_hourly(clusters, VITAL_POLICIES, time_col="cluster_time")
    # published with the declared type; six digits first, so that noise in the last digits of a
    # mean cannot turn a half
    mean = F.round("temperature", 6).cast("decimal(12,6)")
    hourly = hourly.withColumn("temperature", mean.cast("decimal(5,2)"))
    return on_grid(grid, hourly, OUTPUTS["fisi9t_vitalsign_hourly"][3:])


# --- P7 -----------------------------------------------------------------------

PROCEDURE_EVENT_COLUMNS = OUTPUTS["fisi9t_procedureevents_hourly"][3:]


def procedure_events(procedures: DataFrame, window: DataFrame, items: DataFrame) -> DataFrame:
    """Cohort procedures stored inside the stay window, with the item dictionary."""
    return with_items(stored_in_stay(procedures, window), items)


def stored_in_stay(procedures: DataFrame, window: DataFrame) -> DataFrame:
    p = procedures.withColumnRenamed("storetime", "charttime")
    return in_stay_window(p, window, "charttime", on=KEYS).withColumn("charttime_hour", round_to_hour("charttime"))


def with_items(events: DataFrame, items: DataFrame) -> DataFrame:
    di = items.select(
        "itemid", F.col("label").alias("item_label"), F.col("unitname").alias("item_unitname"),
        F.col("lownormalvalue").alias("item_lownormalvalue"),
        F.col("highnormalvalue").alias("item_highnormalvalue"))
    return events.join(di, "itemid", "left")


def _bounded(grid: DataFrame, window: DataFrame) -> DataFrame:
    """The grid with the stay's times on each row (``hour_grid(..., bounds=True)`` has them already)."""
    if "icu_intime" in grid.columns:
        return grid
    return grid.join(window.select(*KEYS, "icu_intime", "icu_outtime"), KEYS)


def events_on_grid(procedures: DataFrame, window: DataFrame, grid: DataFrame) -> DataFrame:
    """Grid LEFT JOIN events on (stay, hour): one row per event inside the stay, one for each empty hour.

    Every in-window event rounds to an hour on its stay's grid (in <= t <= out gives trunc(in) <= round(t) <=
    trunc(out) + 1h), so the stay window is binned into the grid's hours and the range join (J11) is an equi join on
    (subject, stay, hour) with the time test beside it: the events of a hot stay are dealt over its hours.  Events of other
    stays mostly stop at a key filter before the exchange.  Events are read once.
    """
    key = KEYS + ["charttime_hour"]
    grid = _bounded(grid, window)
    cohort = key_filter(window, [as_id(c) for c in KEYS])
    p = procedures.withColumnRenamed("storetime", "charttime").where(F.col("charttime").isNotNull())
    p = p.where(may_hold(cohort, [as_id(c) for c in KEYS])).withColumn("charttime_hour", round_to_hour("charttime"))
    inside = (F.col("p.charttime") >= F.col("g.icu_intime")) & (F.col("p.charttime") <= F.col("g.icu_outtime"))
    same = [F.col(f"g.{c}") == F.col(f"p.{c}") for c in key]
    joined = grid.alias("g").join(p.alias("p"), [*same, inside], "left")
    return joined.select(*[F.col(f"g.{c}").alias(c) for c in key], *[F.col(f"p.{c}").alias(c) for c in p.columns if c not in key])


def procedures_hourly(procedures: DataFrame, window: DataFrame, items: DataFrame,
                      grid: DataFrame | None = None) -> DataFrame:
    """The events of each grid hour, and a row for each hour without one, with the item dictionary.

    ``grid`` (with bounds) may be a part of the window's grid; by default it is all of it."""
    grid = hour_grid(window, bounds=True) if grid is None else grid
    return with_items(events_on_grid(procedures, window, grid), items).select(*OUTPUTS["fisi9t_procedureevents_hourly"])


# --- P8, P9 -------------------------------------------------------------------

def labs_in_stay(labs: DataFrame, window: DataFrame, columns: list[str]) -> DataFrame:
    """Labs carry no stay id: matched on subject to the cohort's stay window."""
    x = in_stay_window(labs.select("subject_id", "charttime", *columns), window, "charttime",
                       on=["subject_id"])
    return x.select(*KEYS, "charttime", round_to_hour("charttime").alias("charttime_hour"), *columns)


def labs_hourly(labs: DataFrame, window: DataFrame, grid: DataFrame, policies: dict[str, str],
                table: str) -> DataFrame:
    """Labs inside the stay window, reduced per hour with ``policies``, on the grid: a binned range join.

    A reading rounds to one hour, and that hour's bin lies wholly inside a stay unless it holds the
    stay's first or last moment.  Readings are reduced per (subject, hour) before any exchange; only in
    hours that may hold such a moment (a key filter of the edge hours) they are reduced per time.  The reduced rows meet
    the grid in an equi join on (subject, hour): inner bins need no time test, edge bins are tested by time.
    So a subject that holds most of the readings leaves each map task as at most one row an hour, its edge hours apart, and
    the join's key is never a subject alone.
    """
    grid = _bounded(grid, window)
    first, last = round_to_hour("icu_intime"), round_to_hour("icu_outtime")
    edges = window.select("subject_id", F.explode(F.array(first, last)).alias("charttime_hour"))
    hour, edge_key = round_to_hour("charttime"), [as_id("subject_id"), F.col("charttime_hour")]
    edge = may_hold(key_filter(edges, edge_key), edge_key)
    rows = labs.select("subject_id", "charttime", hour.alias("charttime_hour"), *policies).where(F.col("charttime").isNotNull())
    states = [a for c, p in policies.items() for a in state_aggs(c, p, order="charttime")]
    reduced = rows.withColumn("_t", F.when(edge, F.col("charttime"))).groupBy("subject_id", "charttime_hour", "_t").agg(*states)
    inner = F.col("r._t").isNull() & (F.col("g.charttime_hour") > first) & (F.col("g.charttime_hour") < last)
    tested = (F.col("r._t") >= F.col("g.icu_intime")) & (F.col("r._t") <= F.col("g.icu_outtime"))
    same = [F.col(f"g.{c}") == F.col(f"r.{c}") for c in ("subject_id", "charttime_hour")]
    joined = grid.alias("g").join(reduced.alias("r"), [*same, inner | tested], "left")
    names = [c for c in reduced.columns if c.startswith("_") and c != "_t"]
    joined = joined.select("g.subject_id", "g.stay_id", "g.charttime_hour", *[f"r.{c}" for c in names])
    merged = [merge_agg(c, p) for c, p in policies.items()]
    return joined.groupBy(*KEYS, "charttime_hour").agg(*merged).select(*KEYS, "charttime_hour", *OUTPUTS[table][3:])


def chemistry_hourly(chem: DataFrame, window: DataFrame, grid: DataFrame | None = None) -> DataFrame:
    """Bicarbonate min, calcium and sodium mean, potassium max per hour."""
    grid = hour_grid(window, bounds=True) if grid is None else grid
    return labs_hourly(chem, window, grid, CHEMISTRY_POLICIES, "fisi9t_chemistry_hourly")


def coagulation_hourly(coag: DataFrame, window: DataFrame, grid: DataFrame | None = None) -> DataFrame:
    """Inr, pt, ptt, thrombin last; d_dimer max; fibrinogen min per hour."""
    grid = hour_grid(window, bounds=True) if grid is None else grid
    return labs_hourly(coag, window, grid, COAGULATION_POLICIES, "fisi9t_coagulation_hourly")
