"""Reading the clinical inputs from storage.

``read_inputs`` loads the ten input tables either from a folder of Parquet
files (``<root>/<table>``) or from catalog tables of a database, always with the
explicit input schema so nothing is inferred at run time.  Column pruning and
filters reach the scan through Catalyst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import INPUTS, conform
from .surrogate import ClinicalTables


def read_input(spark: SparkSession, name: str, root: str | None = None,
               database: str | None = None, fmt: str = "parquet") -> DataFrame:
    schema = INPUTS[name]
    if database is not None or root is None:
        table = f"{database}.{name}" if database else name
        return conform(spark.table(table), schema)
    return spark.read.format(fmt).schema(schema).load(f"{root}/{name}")


def resolve_table(spark: SparkSession, name: str, search_path: list[str]) -> str:
    """``database.name`` for the first database of ``search_path`` holding ``name``
    (unqualified names resolve like a schema search path)."""
    for db in search_path:
        if (db == "global_temp" or spark.catalog.databaseExists(db)) and spark.catalog.tableExists(f"{db}.{name}"):
            return f"{db}.{name}"
    raise LookupError(f"table {name!r} not found in {search_path}")


def read_inputs(spark: SparkSession, root: str | None = None, database: str | None = None,
                fmt: str = "parquet", search_path: list[str] | None = None) -> ClinicalTables:
    """All inputs from a folder (``root``), a catalog ``database``, or the first
    database of ``search_path`` that holds each table."""
    if search_path:
        return ClinicalTables(**{n: conform(spark.table(resolve_table(spark, n, search_path)), INPUTS[n])
                                 for n in INPUTS})
    return ClinicalTables(**{n: read_input(spark, n, root, database, fmt) for n in INPUTS})


def read_jdbc(spark: SparkSession, name: str, url: str, schema_name: str, **options) -> DataFrame:
    """One input straight from a relational database, with partitioned reads when
    ``partitionColumn/lowerBound/upperBound/numPartitions`` are given in ``options``."""
    reader = (spark.read.format("jdbc").option("url", url)
              .option("dbtable", f"{schema_name}.{name}"))
    for k, v in options.items():
        reader = reader.option(k, v)
    return conform(reader.load(), INPUTS[name])
