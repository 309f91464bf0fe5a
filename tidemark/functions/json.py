"""JSON encoding of rows.

Keys are kept when the value is NULL (``ignoreNullFields=false``); zone-less
times are written as ISO text without fractional seconds, decimals as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

JSON_OPTIONS = {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"}


def json_fields(df: DataFrame, columns: list[str]) -> Column:
    """The columns as a struct to encode; decimals become text, as the encoder writes them."""
    decimal = {f.name for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)}
    return F.struct(*[F.col(c).cast("string").alias(c) if c in decimal else F.col(c) for c in columns])


def json_object(df: DataFrame, columns: list[str]) -> Column:
    return F.to_json(json_fields(df, columns), JSON_OPTIONS)
