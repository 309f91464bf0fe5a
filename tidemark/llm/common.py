"""What several operators share: tables, the shared folder, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast by hint only if it was measured to stay under this many bytes.
BROADCAST_BYTES = 8 << 20
#: Rows of a small table that one task takes.
TASK_ROWS = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session (tests) that names none gets a temporary one."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-shared-"))
        d = spark.sparkContext.getCheckpointDir()
    return d.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/tidemark-llm/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Cuts the lineage, so work behind it is not repeated by later jobs, and lost
    executors cost nothing that was staged."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its measured size allows, else unchanged.

    The size is a count times the fixed widths plus the measured lengths of strings
    and arrays, times two for the hash relation.  ``df`` should be staged or cheap."""
    size = F.lit(16)
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(f.name), F.lit(0)) + 16
        elif isinstance(f.dataType, T.ArrayType):
            size = size + F.coalesce(F.size(f.name), F.lit(0)) * 32 + 32
        else:
            size = size + 8
    total = df.agg(F.sum(size.cast("long")).alias("b")).first()["b"] or 0
    return F.broadcast(df) if 2 * total <= max_bytes else df


def in_few(df: DataFrame, rows: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """``df`` in no more partitions than ``rows``, a bound of its rows, need: one for ``task_rows``, and one a core at least.

    A shuffle deals a small table over all its partitions, unless Spark joins them again: each is a task, files of the next
    shuffle and files of a staged table, however few rows it has.  Partitions are joined, rows are not moved."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // task_rows)))


def shielded(docs: DataFrame, needed: Sequence[str], work: Callable[[DataFrame], DataFrame],
             results: Sequence[str] = ()) -> DataFrame:
    """``work`` on ``docs`` with every column but ``needed`` under a name that cannot clash.

    Returns the columns of ``docs`` under their own names, without those that ``results`` replace,
    and ``results``."""
    names = {c.lower() for c in needed}
    inner = {c: c.lower() if c.lower() in names else f"x{i}_" for i, c in enumerate(docs.columns)}
    out = work(docs.select(*[docs[f"`{c}`"].alias(n) for c, n in inner.items()]))
    replaced = {r.lower() for r in results}
    return out.select(*[F.col(n).alias(c) for c, n in inner.items() if c.lower() not in replaced], *results)


def text_batches(batches: Iterable[pa.RecordBatch], chars: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about ``chars`` bytes of their ``text`` column, so
    that a task's memory does not follow the number of long texts in an Arrow batch."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        i, col = 0, b.column(b.schema.get_field_index("text"))
        sizes = pc.binary_length(col).to_pylist()
        while i < n:
            j, left = i, chars
            while j < n and (j == i or left >= (sizes[j] or 0)):
                left -= sizes[j] or 0
                j += 1
            yield b.slice(i, j - i)
            i = j


def crc_mod(doc_id: str, m: int):
    """crc32 of the id as text, modulo ``m`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % m
