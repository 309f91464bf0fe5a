"""Readiness and uniqueness checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def uniqueness_report(df: DataFrame, key: str = "subject_id") -> DataFrame:
    """(rows, distinct keys, keys held by more than one row); the constraint
    holds when the last is 0.  Two partial aggregations, no collect."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(F.sum("_n").cast("long").alias("n_rows"),
                       F.count(F.lit(1)).alias("n_keys"),
                       F.count(F.when(F.col("_n") > 1, 1)).alias("n_duplicated_keys"))


def assert_unique(df: DataFrame, key: str = "subject_id") -> None:
    dup = df.groupBy(key).count().filter(F.col("count") > 1)
    if dup.limit(1).count():
        raise AssertionError(f"{key} is not unique")


def sample_and_count(df: DataFrame, n: int = 5, order: str = "subject_id") -> DataFrame:
    """The readiness sample: ``n`` rows (lowest ``order`` first, so it is
    repeatable) and the table's row count on every row, in the same plan."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.orderBy(order).limit(n).withColumn("total_rows", total.cast("long"))


def readiness(spark: SparkSession, table: str, sample_columns: list[str] | None = None) -> dict:
    """The readiness script's steps: engine version, current database, table
    exists, row count, five sample rows.  Returns a report dict with ``ok``."""
    report = {"engine_version": spark.version, "database": spark.catalog.currentDatabase(),
              "table": table, "exists": spark.catalog.tableExists(table)}
    if not report["exists"]:
        return {**report, "ok": False}
    df = spark.table(table)
    report["count"] = df.count()
    cols = sample_columns or df.columns
    report["sample"] = [r.asDict() for r in df.select(*cols).limit(5).collect()]
    return {**report, "ok": True}
