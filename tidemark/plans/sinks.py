"""JSON sink (K4): rows as JSON lines with NULL fields kept.

Each task writes its own part file; nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.json import JSON_OPTIONS


def write_json(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").options(**JSON_OPTIONS)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.json(path)
