"""Gap sessions (W2-W5): readings of one stay split into clusters wherever two
consecutive readings are more than ``gap`` apart.

Rule (per stay, ordered by time): a reading opens a new cluster when there is no
earlier reading or the previous distinct time is strictly more than ``gap``
before it; readings at equal times share a cluster.  A cluster is named by its
first time (``cluster_time``) and numbered ``cluster_id`` = 1, 2, ... per stay.

Buckets.  Cut time into buckets exactly ``gap`` wide.  Two readings of one bucket
are less than ``gap`` apart, so only the first reading of a bucket can open a
cluster, and it does exactly when the previous non-empty bucket's last reading
is more than ``gap`` before it (an empty bucket in between always means a
larger gap).  So the whole rule runs on per-bucket summaries -- first time, last
time, and whatever sums the caller needs -- which partial aggregation builds
before the shuffle.  A stay with any number of readings becomes at most one row
per ``gap`` of its duration (96 rows a day for 15 minutes); the window that
numbers the clusters runs over those rows only, so no stay, however hot, puts
its readings into one task.  Clusters are runs of consecutive buckets, so
per-cluster results come from the bucket rows, on the stay partitioning the
window already made (no further exchange).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import micros_of, minutes_of

GAP_MINUTES = 15


def bucket_of(time_col: str, gap_minutes: int = GAP_MINUTES) -> Column:
    """Index of the gap-wide time bucket of ``time_col``."""
    minutes, width = minutes_of(time_col), F.lit(gap_minutes)
    return F.call_function("div", minutes - F.pmod(minutes, width), width)


def gap_buckets(df: DataFrame, keys: list[str], time_col: str = "charttime",
                gap_minutes: int = GAP_MINUTES, aggs: list[Column] | None = None) -> DataFrame:
    """One row per (keys, bucket): ``_t_first``, ``_t_last``, ``_n`` and ``aggs``.
    Rows with a NULL time belong to no cluster and are dropped."""
    t = F.col(time_col)
    return (df.filter(t.isNotNull()).withColumn("_bucket", bucket_of(time_col, gap_minutes))
            .groupBy(*keys, "_bucket")
            .agg(F.min(time_col).alias("_t_first"), F.max(time_col).alias("_t_last"),
                 F.count(F.lit(1)).alias("_n"), *(aggs or [])))


def bucket_sessions(buckets: DataFrame, keys: list[str], gap_minutes: int = GAP_MINUTES) -> DataFrame:
    """Adds ``cluster_id`` and ``cluster_time`` to each bucket row."""
    w = Window.partitionBy(*keys).orderBy("_bucket")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prev_last = F.lag("_t_last").over(w)
    opens = prev_last.isNull() | (F.col("_t_first") > prev_last + F.make_dt_interval(mins=F.lit(gap_minutes)))
    b = buckets.withColumn("_opens", opens)
    return (b.withColumn("cluster_id", F.count(F.when(F.col("_opens"), 1)).over(upto))
            .withColumn("cluster_time", F.max(F.when(F.col("_opens"), F.col("_t_first"))).over(upto))
            .drop("_opens"))


def gap_sessions(df: DataFrame, keys: list[str], time_col: str = "charttime",
                 gap_minutes: int = GAP_MINUTES) -> DataFrame:
    """Every reading with its ``cluster_id`` and ``cluster_time`` (NULL times dropped).

    The bucket table is joined back on (keys, bucket); it is unique on that key,
    so the join is a lookup (AQE splits a hot bucket of the reading side)."""
    rows = df.filter(F.col(time_col).isNotNull()).withColumn("_bucket", bucket_of(time_col, gap_minutes))
    clusters = bucket_sessions(gap_buckets(df, keys, time_col, gap_minutes), keys, gap_minutes)
    return (rows.join(clusters.select(*keys, "_bucket", "cluster_id", "cluster_time"), keys + ["_bucket"])
            .drop("_bucket"))


def session_summary(df: DataFrame, keys: list[str], time_col: str = "charttime",
                    gap_minutes: int = GAP_MINUTES) -> DataFrame:
    """One row per cluster: first and last time and the number of readings,
    computed from the bucket rows alone."""
    b = bucket_sessions(gap_buckets(df, keys, time_col, gap_minutes), keys, gap_minutes)
    return (b.groupBy(*keys, "cluster_id", "cluster_time")
            .agg(F.max("_t_last").alias("cluster_end"), F.sum("_n").alias("n_readings")))


def gap_sessions_window(df: DataFrame, keys: list[str], time_col: str = "charttime",
                        gap_minutes: int = GAP_MINUTES) -> DataFrame:
    """The same clusters with Spark's ``session_window``, over bucket rows.

    A bucket row's session lasts from its first reading to the gap after its last one, so
    sessions that touch are one cluster; readings are reduced before any exchange."""
    b = gap_buckets(df, keys, time_col, gap_minutes)
    length = micros_of("_t_last") - micros_of("_t_first") + F.lit(gap_minutes * 60_000_000)
    sw = F.session_window("_t_first", F.concat(length.cast("string"), F.lit(" microseconds")))
    return (b.groupBy(*keys, sw.alias("_sw"))
            .agg(F.min("_t_first").alias("cluster_time"), F.max("_t_last").alias("cluster_end"),
                 F.sum("_n").alias("n_readings"))
            .drop("_sw"))
