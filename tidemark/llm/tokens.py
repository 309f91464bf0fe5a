"""Token ids as Parquet list columns.

``write_tokens`` encodes whole texts and writes one row per document, in ascending
id order over ascending files: ``shard`` (number of the file's task), ``doc_id``,
``shard_start`` (ids before the document in its shard), ``n_tokens`` and ``input_ids``
(list of int).  Files use version-2 pages: an id column that repeats is dictionary
coded, one that does not falls back to delta coding.  Row groups and pages are bounded, and
Parquet's column index (page minima and maxima) is written, so ``read_tokens`` with an id
range and ``read_metadata`` touch only the pages and columns they need.

Null and empty texts hold only the end id.  Rows that repeat a ``doc_id`` stay rows of
their own, ordered by a hash of their text; null ids come first.  Extra input columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast_if_small, new_path, text_batches

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 64 << 10
PAGE_ROWS = 2000
#: Words whose ids a Python worker remembers (about 40 bytes each); only a bound on memory, results do
#: not depend on it.
REMEMBERED = 700_000
#: Ids that go back to the JVM in one piece (1 MB).
SLICE_IDS = 1 << 18
TOKEN_SCHEMA = "shard int, doc_id long, shard_start long, n_tokens long, input_ids array<int>"

# Texts are cut before their spaces.  Byte-level BPE cuts there too before it merges bytes, but for
# a space between other white space, or between white space and the end; such texts, and those with
# characters whose class is in doubt, are encoded whole.
_SPACES = r"\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WHOLE = rf"[{_SPACES}] (?:[{_SPACES}]|$)|[\x1c-\x1f]"
CHAIN = 1000


class TextEncoder:
    """Ids of whole texts with the tokenizers library, each distinct word of a batch encoded once."""

    def __init__(self, tokenizer_path: str):
        # a task is one thread; set before the library starts its own
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        size = self.tokenizer.get_vocab_size()
        # in the byte-level alphabet a character stands for a byte
        self.token_bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)])
        # remembered words: two hashes of each (sorted by the first), place and number of its ids
        self.hash, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.place, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<i4")

    def _ids(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), CHAIN):
            some = self.tokenizer.encode_batch_fast(texts[i:i + CHAIN], add_special_tokens=False)
            out += [np.array(e.ids, dtype="<i4").tobytes() for e in some]
        return out

    def _new_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word with a space before it."""
        out = [b""] * len(words)
        chained, alone = [], []
        for i, w in enumerate(words):
            (chained if w and "<" not in w and not w[0].isspace() and not w[-1].isspace() else alone).append(i)
        for i, x in zip(alone, self._ids([" " + words[i] for i in alone])):
            out[i] = x
        for k in range(0, len(chained), CHAIN):
            some = [words[i] for i in chained[k:k + CHAIN]]
            raw = self._ids([" " + " ".join(some)])[0]
            sizes = np.fromiter((len(w.encode()) + 1 for w in some), np.int64, len(some))
            ends = np.cumsum(self.token_bytes[np.frombuffer(raw, "<i4")])
            cuts = (4 * (np.searchsorted(ends, np.cumsum(sizes)) + 1)).tolist()
            for i, x, y in zip(chained[k:k + CHAIN], [0, *cuts], cuts):
                out[i] = raw[x:y]
        return out

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each of the distinct ``words`` the place and number of its ids among them."""
        h, g = _hashes(words)
        at = np.minimum(np.searchsorted(self.hash, h), max(len(self.hash) - 1, 0))
        hit = (self.hash[at] == h) & (self.check[at] == g) if len(self.hash) else np.zeros(len(h), dtype=bool)
        place, size = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        place[hit], size[hit] = self.place[at[hit]], self.size[at[hit]]
        new = np.flatnonzero(~hit)
        raw = self._new_words(words.take(pa.array(new)).to_pylist())
        size[new] = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        place[new] = len(self.ids) + np.cumsum(size[new]) - size[new]
        ids = np.concatenate([self.ids, np.frombuffer(b"".join(raw), "<i4")])
        if len(self.hash) + len(new) <= REMEMBERED:
            self.ids = ids
            order = np.argsort(h[new], kind="stable")
            some = new[order]
            to = np.searchsorted(self.hash, h[some])
            self.hash, self.check = np.insert(self.hash, to, h[some]), np.insert(self.check, to, g[some])
            self.place, self.size = np.insert(self.place, to, place[some]), np.insert(self.size, to, size[some])
        return ids, place, size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of ids of each; null is empty."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, _WHOLE).to_numpy(zero_copy_only=False)
        if whole.any():
            rest = texts.filter(pa.array(~whole))
            flat, n = self._split(rest) if len(rest) else (np.zeros(0, "<i4"), np.zeros(0, np.int64))
            parts = iter(np.split(flat, np.cumsum(n)[:-1]) if len(n) else [])
            odd = iter(self._ids(texts.filter(pa.array(whole)).to_pylist()))
            each = [np.frombuffer(next(odd), "<i4") if w else next(parts) for w in whole.tolist()]
            return np.concatenate(each), np.array([len(x) for x in each], dtype=np.int64)
        return self._split(texts)

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(texts, " ")
        flat = lists.flatten()
        starts = np.cumsum(np.append(0, pc.list_value_length(lists).to_numpy()))
        coded = flat.dictionary_encode()
        index = coded.indices.to_numpy().astype(np.int64)
        ids, place, size = self._words(coded.dictionary)
        # the first word of a text has no space before it
        first = starts[:-1]
        raw = self._ids(flat.take(pa.array(first)).to_pylist())
        n_first = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        values = np.concatenate([ids, np.frombuffer(b"".join(raw), "<i4")])
        place, n = place[index], size[index]
        place[first], n[first] = len(ids) + np.cumsum(n_first) - n_first, n_first
        before = np.cumsum(n) - n
        out = values[np.repeat(place - before, n) + np.arange(n.sum())]
        return out, np.add.reduceat(n, first)


def _hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each string: sums over its bytes of a random number for the byte times
    one for its position."""
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data else np.zeros(0, np.uint8)
    starts, length = offsets[:-1] - offsets[0], np.diff(offsets)
    position = np.arange(len(data)) - np.repeat(starts, length)
    out = []
    for seed in (1, 2):
        rng = np.random.default_rng(seed)
        byte = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        by_position = rng.integers(0, 1 << 64, int(length.max(initial=0)) + 1, dtype=np.uint64) | np.uint64(1)
        h = np.zeros(len(words), np.uint64)
        some = length > 0
        if some.any():
            h[some] = np.add.reduceat(byte[data] * by_position[position], starts[some])
        out.append(h)
    return out[0], out[1]


_ENCODERS: dict[str, TextEncoder] = {}


def _encoder(tokenizer_path: str) -> TextEncoder:
    """One encoder for each Python worker, kept over its tasks."""
    if tokenizer_path not in _ENCODERS:
        _ENCODERS[tokenizer_path] = TextEncoder(tokenizer_path)
    return _ENCODERS[tokenizer_path]


def _encode(tokenizer_path: str, end_id: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, start = TaskContext.get().partitionId(), 0
        encoder = _encoder(tokenizer_path)
        for b in text_batches(batches):
            ids, n = encoder.encode(b.column("text"))
            ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
            offsets = np.concatenate([[0], np.cumsum(n)])
            yield pa.record_batch({
                "shard": pa.array(np.full(len(n), shard, dtype=np.int32)),
                "doc_id": pc.cast(b.column("doc_id"), pa.int64()),
                "shard_start": pa.array(start + offsets[:-1]),
                "n_tokens": pa.array(n),
                "input_ids": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32))),
            })
            start += int(offsets[-1])
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0) -> None:
    """Encodes ``docs`` (doc_id, text) and writes the token files to ``path``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = docs.withColumn("_h", F.xxhash64("text")).repartitionByRange("doc_id", "_h") \
        .sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    tokens = ordered.mapInArrow(_encode(tokenizer_path, end_id), TOKEN_SCHEMA)
    (tokens.write.option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES)
     .option("parquet.page.row.count.limit", PAGE_ROWS).option("parquet.writer.version", "v2")
     .option("parquet.enable.dictionary", "true").option("compression", "zstd").parquet(path))


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None,
                ids: bool = True) -> DataFrame:
    """Rows of the token files with ``first <= doc_id <= last``; the range is pushed to the
    scan.  With ``ids=False`` the id lists are not read."""
    df = spark.read.schema(TOKEN_SCHEMA).parquet(path)
    if first is not None:
        df = df.where(F.col("doc_id") >= first)
    if last is not None:
        df = df.where(F.col("doc_id") <= last)
    return df if ids else df.drop("input_ids")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and n_tokens, without reading ids."""
    rows = read_tokens(spark, path, ids=False)
    return rows.join(broadcast_if_small(_shard_offsets(spark, path)), "shard").select(
        "doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens")


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _ENCODERS.clear()  # a worker that encoded before needs the room for whole id lists
    for b in batches:
        for part in _id_slices(b):
            lists = part.column("input_ids")
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            data = memoryview(np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), dtype="<i4")).cast("B")
            crc = [zlib.crc32(data[4 * i:4 * j]) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.record_batch({
                "shard": part.column("shard"), "doc_id": part.column("doc_id"), "shard_start": part.column("shard_start"),
                "n_tokens": pa.array(np.diff(offsets).astype(np.int64)), "input_ids": lists, "ids_crc32": pa.array(crc, pa.int64()),
            })


def _id_slices(b: pa.RecordBatch, ids: int = SLICE_IDS) -> Iterator[pa.RecordBatch]:
    """The batch cut into slices of about ``ids`` ids (a longer list is a slice of its own): the JVM holds one slice at
    a time of what comes back, whatever an Arrow batch holds."""
    offsets = b.column("input_ids").offsets.to_numpy()
    i = 0
    while i < b.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + ids, side="right")) - 1)
        yield b.slice(i, j - i)
        i = j


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, input_ids and the crc32 of the ids."""
    rows = read_tokens(spark, path).mapInArrow(_digest, TOKEN_SCHEMA + ", ids_crc32 long")
    return rows.join(broadcast_if_small(_shard_offsets(spark, path)), "shard").select(
        "doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", "input_ids", "ids_crc32")


def _shard_offsets(spark: SparkSession, path: str) -> DataFrame:
    """Ids before each shard; one row per file, so the window is small whatever the input."""
    totals = read_tokens(spark, path, ids=False).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    return totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))


def encode_to_shared(docs: DataFrame, tokenizer_path: str, end_id: int = 0, path: str | None = None) -> str:
    """``write_tokens`` to ``path`` (a new folder of the shared one if none is given)."""
    path = path or new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path, end_id)
    return path
