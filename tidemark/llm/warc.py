"""WARC archives: a deterministic sharded writer, and a reader that checks what it reads.

``write_archives`` turns rows (``page_id``, ``url``, ``html``) into gzipped WARC records, one gzip member each:

1. Records are ordered by id, then payload digest.  Shards are ranges of that order of about
   ``shard_bytes`` of payload.  Their bounds come from byte counts of ranges of ids, refined where a
   range is too large (a repeated id is cut by digest), so they depend on the rows alone and not
   on their partitioning, and the driver gets a bounded number of counts per shard.
2. Equal payloads of at least ``min_revisit`` bytes are stored once: the record of the smallest id is the
   response, the others are revisits that name it.  Revisits are found on (id, digest) rows;
   those of one payload are salted.
3. Responses are compressed where they are read.  They and the (id, digest, response) rows of the revisits are
   dealt by shard and sorted, and a shard's task writes its records to files
   that end before they would exceed ``file_bytes`` compressed.  Headers, record ids and digests follow from the row; the
   date is a parameter, so equal input gives equal files.
4. Files get names of their own attempt, and each task returns their rows of the manifest.  Spark commits one
   attempt's rows of each task; then these files are renamed, the manifest is written,
   and what is left under temporary names is deleted.  Readers go by the manifest, which appears last.

Null and empty html is an empty payload, without a limit on its size but that of a row.  Rows without an id come
last, and the records have no id; they are revisits of the smallest id's row, or of the first of them if no row has one.
Rows that repeat an id and a payload are one response and its revisits.  An empty table gives a manifest
without files.  Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast_if_small, stage, text_batches

#: A digest's revisits are dealt over this many tasks.
SALTS = 16
#: Byte counts per shard, at first and of a range that is refined.
BINS, FINER = 8, 10
LAST = 2**63 - 1
#: Read and inflated at once.
CHUNK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, sequence int, temporary string, file string, bytes long, records long, sha256 string"
RECORDS = ("page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, "
           "file string, offset long, bytes long")


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path of the shared folder, as executors see it, and the path in it."""
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), re.sub(r"^file:", "", uri)


# --- records --------------------------------------------------------------------

def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record with the digest and length of its block, as a gzip member without a time."""
    digest = hashlib.sha256(block).hexdigest()
    head = [*fields, ("WARC-Block-Digest", f"sha256:{digest}"), ("Content-Length", str(len(block)))]
    raw = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw.encode() + block + b"\r\n\r\n") + z.flush()


def _record_id(page_id: int | None, digest: str, repeat: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}:{repeat}')}>"


def page_record(page_id: int | None, url: str | None, digest: str, size: int, payload: bytes | None, date: str,
                repeat: int = 0, refers: tuple[int | None] | None = None) -> bytes:
    """The response of a page, or its revisit if ``refers`` holds the response's id."""
    kind = "response" if refers is None else "revisit"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", _record_id(page_id, digest, repeat)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="%/:?#[]@!$&'()*+,;=~-._")))
    fields += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if page_id is not None:
        fields.append(("WARC-X-Page-ID", str(page_id)))
    if refers is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers[0], digest, 0))]
        if refers[0] is not None:
            fields.append(("WARC-X-Refers-To-Page-ID", str(refers[0])))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    return _record(fields, http if refers is not None else http + payload)


def _info_record(file: str, date: str) -> bytes:
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, file)}>"),
              ("WARC-Date", date), ("WARC-Filename", file), ("Content-Type", "application/warc-fields")]
    return _record(fields, b"format: WARC File Format 1.1\r\n")


# --- shards ---------------------------------------------------------------------

def shard_bounds(sizes: DataFrame, shard_bytes: int) -> list[tuple[int, int]]:
    """Where shards but the first start, as (key, tie).  ``sizes`` has longs key, tie, bytes."""
    total, low, high = sizes.agg(F.sum("bytes"), F.min("key"), F.max("key")).first()
    if not total or total <= shard_bytes:
        return []
    bins, shift = BINS * -(-total // shard_bytes), 0
    while (high >> shift) - (low >> shift) > bins:
        shift += 1

    def counted(rows: DataFrame, shift: int) -> list[tuple[int, int]]:
        return [(r["bin"] << shift, r["n"]) for r in
                rows.groupBy(F.shiftright("key", shift).alias("bin")).agg(F.sum("bytes").alias("n")).collect()]

    done: dict[tuple[int, int], int] = {}
    found = counted(sizes, shift)
    while True:
        large = [k for k, n in found if n > shard_bytes]
        done.update({(k, -LAST - 1): n for k, n in found if n <= shard_bytes})
        if not large:
            break
        # at most one range for every shard's bytes
        keys = F.broadcast(sizes.sparkSession.createDataFrame([(k >> shift,) for k in large], "bin long"))
        rows = sizes.withColumn("bin", F.shiftright("key", shift)).join(keys, "bin", "left_semi").drop("bin")
        if shift:
            shift = max(0, shift - FINER)
            found = counted(rows, shift)
            continue
        for r in rows.groupBy("key", F.shiftright("tie", 64 - FINER).alias("t")).agg(F.sum("bytes").alias("n")).collect():
            done[(r["key"], r["t"] << (64 - FINER))] = r["n"]
        break
    bounds, held = [], 0
    for at in sorted(done):
        if held and held + done[at] > shard_bytes:
            bounds.append(at)
            held = 0
        held += done[at]
    return bounds


def revisits(keys: DataFrame, min_revisit: int) -> DataFrame:
    """(page_id, digest, refers_to) of rows whose payload a smaller id has."""
    some = keys.where(F.col("bytes") >= min_revisit).select("page_id", "digest")
    first = some.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("_last"),
                                       F.count("page_id").alias("_ids"), F.count(F.lit(1)).alias("_n"))
    first = first.where("refers_to < _last OR _ids < _n AND _ids > 0").select(
        "digest", "refers_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = some.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    found = salted.join(broadcast_if_small(first), ["digest", "salt"])
    return found.where("page_id IS NULL OR page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


# --- writer ---------------------------------------------------------------------

def write_archives(pages: DataFrame, path: str, shard_bytes: int = 64 << 20, file_bytes: int = 16 << 20,
                   min_revisit: int = 100, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes the archives under ``path`` (new, in a folder that driver and executors share); returns the manifest."""
    spark = pages.sparkSession
    text = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), text.alias("text"),
                        F.sha2(text.cast("binary"), 256).alias("digest"))
    keys = stage(rows.select("page_id", "digest", F.octet_length("text").cast("long").alias("bytes")), "warc-keys")
    key = F.coalesce("page_id", F.lit(LAST))
    bounds = shard_bounds(keys.select(key.alias("key"), F.xxhash64("digest").alias("tie"), F.greatest("bytes", F.lit(100)).alias("bytes")),
                          shard_bytes)
    decided = revisits(keys, min_revisit).select("page_id", F.lit(None).cast("string").alias("url"), F.lit("").alias("text"),
                                                 "digest", "refers_to", F.lit(0).alias("tag"))
    both = rows.select("*", F.lit(None).cast("long").alias("refers_to"), F.lit(1).alias("tag")).unionByName(decided)
    both = both.select("tag", key.alias("key"), F.xxhash64("digest").alias("tie"), "page_id", "url", "digest", "refers_to", "text")
    columns = "tag int, key long, tie long, page_id long, url string, digest string, refers_to long"

    def compressed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the shard, the payload's size, and the response (of a small payload, the payload)."""
        for b in text_batches(batches):
            shard, size, data = [], [], []
            for r in b.to_pylist():
                shard.append(bisect.bisect_right(bounds, (r["key"], r["tie"])))
                payload = r["text"].encode("utf-8", "surrogatepass")
                size.append(len(payload))
                data.append(payload if not r["tag"] or len(payload) < min_revisit else
                            page_record(r["page_id"], r["url"], r["digest"], len(payload), payload, date))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(shard, pa.int32()), pa.array(size, pa.int64()), pa.array(data, pa.binary())],
                names=[*b.schema.names[:-1], "shard", "size", "data"])

    def written(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _write_shards(batches, path, file_bytes, min_revisit, date)

    order = ["shard", "key", F.asc_nulls_last("page_id"), "digest", "tag", "url"]
    dealt = both.mapInArrow(compressed, f"{columns}, shard int, size long, data binary") \
        .repartition(len(bounds) + 1, "shard").sortWithinPartitions(*order)
    done = stage(dealt.mapInArrow(written, MANIFEST), "warc-files")

    def renamed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(path)
        for b in batches:
            for r in b.to_pylist():
                _rename(fs, f"{root}/{r['temporary']}", f"{root}/{r['file']}", r["bytes"])
            yield b

    tasks = max(1, min(len(bounds) + 1, spark.sparkContext.defaultParallelism))
    done.repartition(tasks, "file").mapInArrow(renamed, MANIFEST).drop("temporary").write.parquet(f"{path}/manifest")
    _delete(spark, f"{path}/_temporary_files")
    return manifest(spark, path)


def _rename(fs: pafs.FileSystem, source: str, target: str, size: int) -> None:
    """May run again after a lost task: a file that is there in full stays."""
    there = fs.get_file_info(target)
    if there.type == pafs.FileType.File and there.size == size:
        return
    fs.move(source, target)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class _File:
    """An archive under a temporary name."""

    def __init__(self, fs: pafs.FileSystem, folder: str, shard: int, sequence: int, temporary: str, date: str):
        self.name = f"part-{shard:06d}-{sequence:05d}.warc.gz"
        self.row = {"shard": shard, "sequence": sequence, "temporary": f"{temporary}/{self.name}", "file": self.name}
        self.bytes = self.records = 0
        self.digest = hashlib.sha256()
        self.out = fs.open_output_stream(f"{folder}/{temporary}/{self.name}", compression=None)
        self.add(_info_record(self.name, date))
        self.records = 0

    def add(self, record: bytes) -> None:
        self.out.write(record)
        self.digest.update(record)
        self.bytes += len(record)
        self.records += 1

    def close(self) -> dict:
        self.out.close()
        return {**self.row, "bytes": self.bytes, "records": self.records, "sha256": self.digest.hexdigest()}


def _write_shards(batches: Iterable[pa.RecordBatch], path: str, file_bytes: int, min_revisit: int,
                  date: str) -> Iterator[pa.RecordBatch]:
    """Sorted rows of whole shards to files; yields the files' rows."""
    fs, folder = filesystem(path)
    temporary = f"_temporary_files/{uuid.uuid4().hex}"
    out, done = None, []
    refers, last, repeat = None, None, 0
    for b in batches:
        for r in b.to_pylist():
            at = (r["page_id"], r["digest"])
            if not r["tag"]:
                refers = (at, r["refers_to"])
                continue
            repeat = repeat + 1 if at == last else 0
            last = at
            if r["size"] < min_revisit:
                record = page_record(r["page_id"], r["url"], r["digest"], r["size"], r["data"], date, repeat)
            elif refers is not None and refers[0] == at:
                record = page_record(r["page_id"], r["url"], r["digest"], r["size"], None, date, repeat, (refers[1],))
            elif repeat:
                record = page_record(r["page_id"], r["url"], r["digest"], r["size"], None, date, repeat, (r["page_id"],))
            else:
                record = r["data"]
            if out is None or out.row["shard"] != r["shard"] or out.records and out.bytes + len(record) > file_bytes:
                if out is None:
                    fs.create_dir(f"{folder}/{temporary}")
                else:
                    done.append(out.close())
                same = out is not None and out.row["shard"] == r["shard"]
                out = _File(fs, folder, r["shard"], out.row["sequence"] + 1 if same else 0, temporary, date)
            out.add(record)
    if out is not None:
        done.append(out.close())
    schema = pa.schema([("shard", pa.int32()), ("sequence", pa.int32()), ("temporary", pa.string()), ("file", pa.string()),
                        ("bytes", pa.int64()), ("records", pa.int64()), ("sha256", pa.string())])
    yield pa.RecordBatch.from_pylist(done, schema=schema)


# --- reader ---------------------------------------------------------------------

def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The files under ``path``: shard, sequence, file, bytes, records, sha256."""
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest").drop("temporary")


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The page records of the archives, with their place in the files; with ``payloads`` those of responses
    too.  Digests, sizes and the manifest's counts are checked; what differs raises an error."""
    files = manifest(spark, path).select("file", "bytes", "records", "sha256")
    more = [("payload", pa.binary())] if payloads else []
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()),
                        ("file", pa.string()), ("offset", pa.int64()), ("bytes", pa.int64()), *more])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(path)
        for b in batches:
            for f in b.to_pylist():
                some, held, n = [], 0, 0
                for r in read_file(fs, root, f):
                    some.append(r)
                    n += 1
                    held += len(r["payload"]) if payloads else 200
                    if held > CHUNK:
                        yield pa.RecordBatch.from_pylist(some, schema=schema)
                        some, held = [], 0
                if n != f["records"]:
                    raise ValueError(f"{f['file']}: {n} records, {f['records']} in the manifest")
                yield pa.RecordBatch.from_pylist(some, schema=schema)

    tasks = max(1, files.count())
    return files.repartition(tasks, "file").mapInArrow(work, RECORDS + (", payload binary" if payloads else ""))


def read_file(fs: pafs.FileSystem, root: str, row: dict) -> Iterator[dict]:
    """The page records of one file of the manifest, one gzip member at a time."""
    digest, offset, rest = hashlib.sha256(), 0, b""
    with fs.open_input_stream(f"{root}/{row['file']}", compression=None) as f:
        while True:
            z, parts, used = zlib.decompressobj(31), [], 0
            while not z.eof:
                data = rest or f.read(CHUNK)
                rest = b""
                if not data:
                    break
                parts.append(z.decompress(data))
                rest = z.unused_data
                taken = data[:len(data) - len(rest)]
                used += len(taken)
                digest.update(taken)
            if not used:
                break
            if not z.eof:
                raise ValueError(f"{row['file']}: cut off at {offset}")
            r = _parsed(b"".join(parts), f"{row['file']} at {offset}")
            if r is not None:
                yield {**r, "file": row["file"], "offset": offset, "bytes": used}
            offset += used
    if offset != row["bytes"] or digest.hexdigest() != row["sha256"]:
        raise ValueError(f"{row['file']} is not the file of the manifest")


def _fields(raw: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = raw.decode().split("\r\n")
    return first, {k: v for k, _, v in (x.partition(": ") for x in lines)}


def _parsed(raw: bytes, where: str) -> dict | None:
    head, _, body = raw.partition(b"\r\n\r\n")
    version, fields = _fields(head)
    size = int(fields["Content-Length"])
    block = body[:size]
    if not version.startswith("WARC/1.") or body[size:] != b"\r\n\r\n":
        raise ValueError(f"{where}: not a record")
    if fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"{where}: the block has another digest")
    if fields["WARC-Type"] not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    size, digest = int(_fields(http)[1]["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{where}: the payload has another size or digest")
    whole = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": whole("WARC-X-Page-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
            "payload_bytes": size, "payload_digest": digest, "refers_to": whole("WARC-X-Refers-To-Page-ID"), "payload": payload}
