"""Clinical rows that several tests build by hand."""

from __future__ import annotations

from datetime import datetime

from tidemark.schemas import INPUTS
from tidemark.sources.surrogate import ClinicalTables


def ts(text: str) -> datetime:
    return datetime.fromisoformat(text)


def frame(spark, name: str, rows: list[dict]):
    """A DataFrame with the input schema of ``name``; missing fields are NULL."""
    schema = INPUTS[name]
    data = [tuple(r.get(f.name) for f in schema.fields) for r in rows]
    return spark.createDataFrame(data, schema)


def tables(spark, **rows) -> ClinicalTables:
    return ClinicalTables(**{n: frame(spark, n, rows.get(n, [])) for n in INPUTS})
