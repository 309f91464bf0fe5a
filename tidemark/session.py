"""Spark session settings the library relies on.

Times in the clinical tables carry no zone, so the session runs in UTC and every
time column is ``timestamp_ntz``.  AQE stays on: it coalesces small shuffle
partitions, turns shuffle joins into broadcast joins once a side is measured to
be small, and splits skewed join partitions.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job of the library expects (cluster or local).
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.useObjectHashAggregateExec": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "tidemark") -> SparkSession:
    """Session for tests, benches and local runs.

    On a cluster, ``master`` stays ``None`` so spark-submit decides, and the
    shuffle partition count is left to the cluster config (AQE coalesces it).
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in REQUIRED_CONF.items():
        b = b.config(k, v)
    # plans are built by many small calls; without a call site noted for each they take half the time
    b = b.config("spark.python.sql.dataFrameDebugging.enabled", "false")
    b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master and master.startswith("local"):
        b = b.config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"))
        # small local inputs: let AQE keep a few partitions per shuffle instead of one
        b = b.config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128KB")
    spark = b.getOrCreate()
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session.  Only when it is unset
    (local tests) a scratch folder is created and registered.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-ckpt-"))
        d = spark.sparkContext.getCheckpointDir()
    return d.rstrip("/")
