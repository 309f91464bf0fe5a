"""What stored tables allow beyond their rows: bucketed copies, an order proof, readiness from footers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import files


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Session settings (``__`` for dots) that hold inside the block."""
    names = {k.replace("__", "."): v for k, v in conf.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# --- K3: co-located joins -----------------------------------------------------------

def save_bucketed(df: DataFrame, name: str, path: str, keys: list[str], buckets: int) -> DataFrame:
    """``df`` as catalog table ``name``, its files under ``path`` bucketed and sorted by ``keys``; the table read back.

    Two tables with equal buckets of the same keys join on them without an exchange, whatever their size.  Rows are dealt
    to their bucket before the write, so each bucket is one file."""
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def bucketed_on_grid(spark: SparkSession, grid: DataFrame, hourly: DataFrame, path: str, buckets: int) -> DataFrame:
    """Grid LEFT JOIN hourly (J9) over two stored tables that are bucketed by (stay_id, charttime_hour).

    The hour is part of the bucket, so a stay with very many hours is dealt over all buckets."""
    keys, token = ["stay_id", "charttime_hour"], uuid.uuid4().hex
    g = save_bucketed(grid, f"tidemark_grid_{token}", f"{path}/grid", keys, buckets)
    h = save_bucketed(hourly, f"tidemark_hourly_{token}", f"{path}/hourly", keys, buckets)
    # the buckets are the point: no broadcast, no exchange
    return g.join(h.drop("subject_id").hint("merge"), keys, "left")


# --- O1, O2: stored order -----------------------------------------------------------

#: Rows of a file that one window looks at.
CHUNK_ROWS = 1 << 16


def order_check(spark: SparkSession, path: str, keys: list[str], partitions: list[str] = ()) -> DataFrame:
    """One row: ``n_rows``, ``n_out_of_order`` (rows below the row before them in their file) and ``n_overlaps`` (files
    that begin below the end of the file before them) of a stored table.

    Files carry their place in their name, rows theirs in the file.  Every file's rows are compared chunk by chunk, then
    the ends of chunks, then the key ranges of files (of a table in ``partitions``, in each directory), so no task holds
    a whole file's rows.  Nulls come first, as the sort of the write puts them."""
    key = F.struct(*[F.struct(F.col(k).isNotNull().alias("some"), F.col(k).alias("v")) for k in keys])
    rows = spark.read.parquet(path).select(key.alias("key"), F.struct(F.lit(0), *partitions).alias("folder"), F.col("_metadata.file_name").alias("file"),
                                           F.col("_metadata.row_index").alias("at"))
    rows = rows.withColumn("chunk", F.floor(F.col("at") / CHUNK_ROWS))
    before = F.lag("key").over(Window.partitionBy("folder", "file", "chunk").orderBy("at"))
    chunks = rows.withColumn("_low", before > F.col("key")).groupBy("folder", "file", "chunk").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_low").alias("low"), F.min_by("key", "at").alias("first"),
        F.max_by("key", "at").alias("last"))
    previous = F.lag("last").over(Window.partitionBy("folder", "file").orderBy("chunk"))
    whole = chunks.withColumn("_low", previous > F.col("first")).groupBy("folder", "file").agg(
        F.sum("n").alias("n"), (F.sum("low") + F.count_if("_low")).alias("low"), F.min("first").alias("first"), F.max("last").alias("last"))
    ahead = F.lag("last").over(Window.partitionBy("folder").orderBy("file"))
    return whole.withColumn("_over", ahead > F.col("first")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows"), F.coalesce(F.sum("low"), F.lit(0)).cast("long").alias("n_out_of_order"),
        F.count_if("_over").alias("n_overlaps"))


# --- P19, A15: readiness from footers -----------------------------------------------

def footer_counts(spark: SparkSession, path: str) -> DataFrame:
    """One row, ``n_rows`` of a stored Parquet table, from its files' footers: no row is read.

    The reader that can do so is chosen when the table is opened; that counts are pushed down to it is one of the
    session's settings (``REQUIRED_CONF``)."""
    with settings(spark, spark__sql__sources__useV1SourceList=""):
        table = spark.read.parquet(path)
    n = F.col("n")  # a pushed count over no row group is null, though typed as never null
    return table.agg(F.count(F.lit(1)).alias("n")).select(F.when(n >= 0, n).otherwise(0).alias("n_rows"))


def readiness_report(spark: SparkSession, tables: dict[str, str | None], required: dict[str, list[str]]) -> DataFrame:
    """Readiness (P19) as rows: (table, ready, n_rows, missing) for each name of ``required``.

    ``tables`` has the stored folder of each name (None or absent: not there); ``missing`` lists required columns that it does not
    have.  A table is ready if it is there with all of them and holds rows.  Counts come from footers."""
    out = None
    for name, columns in required.items():
        path = tables.get(name)
        there = path is not None and files.exists(spark, path)
        if there:
            lacks = [c for c in columns if c not in spark.read.parquet(path).columns]
            counted = footer_counts(spark, path)
        else:
            lacks, counted = list(columns), spark.range(1).select(F.lit(None).cast("long").alias("n_rows"))
        row = counted.select(F.lit(name).alias("table"), (F.lit(there and not lacks) & F.coalesce(F.col("n_rows") > 0, F.lit(False))).alias("ready"),
                             "n_rows", F.lit(",".join(lacks)).alias("missing"))
        out = row if out is None else out.unionByName(row)
    return out
