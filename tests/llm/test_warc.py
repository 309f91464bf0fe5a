"""WARC archives (operator 12): round trips, the same files from any partitioning, rolled files, lost attempts."""

from __future__ import annotations

import gzip
import hashlib
import os
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

from llm_cases import SF
from tidemark.llm import warc
from tidemark.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "page_id long, url string, html string"
LONG = "<p>same words again</p>" * 20


def pages(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def new_folder() -> str:
    return tempfile.mkdtemp(prefix="tidemark-warc-") + "/out"


def files(path: str) -> dict[str, bytes]:
    return {f: open(f"{path}/{f}", "rb").read() for f in os.listdir(path) if f.endswith(".warc.gz")}


def test_round_trip_with_nulls_ties_and_repeated_rows(spark):
    rows = [(5, "http://a/5", LONG), (3, "http://a/3?q=ä b", LONG), (9, None, LONG), (3, "http://a/3", LONG), (None, "http://a/n", LONG),
            (7, "http://a/7", None), (8, "http://a/8", ""), (1, "http://a/1", "<p>short</p>"), (2, "http://a/2", "<p>short</p>"),
            (2, "http://a/2", "<p>short</p>"), (4, "http://a/4", "é日\U0001f600" * 400_000), (None, None, "no id " * 30), (None, None, "no id " * 30)]
    df = pages(spark, rows).withColumn("digest", F.lit("x")).withColumn("shard", F.lit(3)).withColumn("Text", F.lit(None))
    path = new_folder()
    warc.write_archives(df, path)
    got = warc.read_archives(spark, path, payloads=True).collect()
    assert len(got) == len(rows)
    kinds = [(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got]
    size = len(LONG)
    want = [(5, "revisit", 3, size), (3, "response", None, size), (9, "revisit", 3, size), (3, "revisit", 3, size), (None, "revisit", 3, size),
            (7, "response", None, 0), (8, "response", None, 0), (1, "response", None, 12), (2, "response", None, 12), (2, "response", None, 12),
            (4, "response", None, 3_600_000), (None, "response", None, 180), (None, "revisit", None, 180)]
    assert sorted(kinds, key=repr) == sorted(want, key=repr)
    for r in got:
        if r.record_type == "response":
            assert hashlib.sha256(r.payload).hexdigest() == r.payload_digest and len(r.payload) == r.payload_bytes
    ids = [line for b in files(path).values() for line in gzip.decompress(b).split(b"\r\n") if line.startswith(b"WARC-Record-ID")]
    assert len(set(ids)) == len(ids)


def test_same_files_from_any_partitioning(spark):
    rows = [(i * 37 % 5000, f"http://a/{i}", f"<p>{i % 300} " + "text " * (i % 70) + "</p>") for i in range(3000)]
    seen = []
    for k in (1, 7):
        path = new_folder()
        m = warc.write_archives(pages(spark, rows).repartition(k), path, shard_bytes=100_000, file_bytes=6_000)
        seen.append(files(path))
        assert sorted(r.file for r in m.collect()) == sorted(seen[-1]) and not os.path.exists(f"{path}/_temporary_files")
        sizes = {r.file: r.bytes for r in m.collect()}
        assert sizes == {f: len(b) for f, b in seen[-1].items()} and max(sizes.values()) <= 6_000
        assert len({r.shard for r in m.collect()}) > 4 and max(r.sequence for r in m.collect()) > 0
        got = warc.read_archives(spark, path)
        ids = [r.page_id for r in got.sort("file", "offset").collect()]
        assert ids == sorted(ids) and len(ids) == 3000
        one = got.where("record_type = 'response'").first()  # a record is a gzip member of its own
        member = gzip.decompress(seen[-1][one.file][one.offset:one.offset + one.bytes])
        assert member.startswith(b"WARC/1.1\r\n") and one.payload_digest.encode() in member
    assert seen[0] == seen[1]


def test_a_hot_id_and_far_ids_are_cut(spark):
    rows = [(7, None, f"{i} " * 60) for i in range(400)] + [(2**62, None, "far"), (-2**63, None, "low"), (None, None, "none")]
    df = pages(spark, rows)
    sizes = df.select(F.coalesce("page_id", F.lit(warc.LAST)).alias("key"), F.xxhash64("html").alias("tie"), F.lit(1000).cast("long").alias("bytes"))
    bounds = warc.shard_bounds(sizes, 50_000)
    assert bounds == sorted(bounds) and sum(k == 7 for k, _ in bounds) >= 6
    path = new_folder()
    warc.write_archives(df, path, shard_bytes=10_000, file_bytes=4_000)
    assert warc.read_archives(spark, path).count() == len(rows)


def test_files_of_lost_attempts_and_damage(spark):
    rows = [(i, "http://a", f"<p>{i}</p>" * 30) for i in range(50)]
    path = new_folder()
    os.makedirs(f"{path}/_temporary_files/lost")
    open(f"{path}/_temporary_files/lost/part-000000-00000.warc.gz", "wb").write(b"half")
    warc.write_archives(pages(spark, rows), path)
    assert warc.read_archives(spark, path).count() == 50 and not os.path.exists(f"{path}/_temporary_files")
    name, raw = next(iter(files(path).items()))
    for bad in (raw[:-5], raw[:200] + b"\0" + raw[201:], raw + raw):
        open(f"{path}/{name}", "wb").write(bad)
        with pytest.raises(Exception):
            warc.read_archives(spark, path).count()


def test_renaming_again_keeps_the_file(tmp_path):
    fs, root = warc.filesystem(f"file://{tmp_path}")
    (tmp_path / "a").write_bytes(b"123")
    for _ in range(2):
        warc._rename(fs, f"{root}/a", f"{root}/b", 3)
    assert (tmp_path / "b").read_bytes() == b"123"


def test_empty_table(spark):
    path = new_folder()
    assert warc.write_archives(pages(spark, []), path).count() == 0
    assert warc.read_archives(spark, path).count() == 0


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    res = con.execute(ORACLE_SQL["op12_warc"])
    cols = [d[0] for d in res.description]
    want = sorted(tuple(sorted(zip(cols, r))) for r in res.fetchall())
    got = sorted(tuple(sorted(r.asDict().items())) for r in QUERIES["op12_warc"](spark, SF).collect())
    assert got == want
