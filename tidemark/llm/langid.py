"""Language identification by nearest centroid.

A text is lower-cased, every run of other characters than letters becomes one space, and its
character 1- to 3-grams are counted in ``DIMS`` hashed dimensions.  Counts are weighted by
inverse document frequency and normalised.  The vectors of every language
are clustered (spherical k-means), so a language has several centroids; a text gets the
language of the centroid with the greatest cosine.  The score is that cosine.  A text that is
clearly farther from its centroid than nearly all learned texts of the language are from theirs is
rejected: the column ``rejected`` is true, the nearest language is still given.

Document frequencies are counted over all learnable texts.  Clusters are fitted on at most
``max_docs`` of them in each language (smallest hash of id and text), so a rare language is learned
beside a hot one; each language is clustered in a task of its own, and the driver gets its centroids.  Null texts and texts without letters get
``und`` and score 0.  Rows are judged one by one; an empty table gives an empty result; extra
columns are ignored.  Without a learnable row every text gets ``und``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast_if_small, crc_mod, stage, text_batches

DIMS = 4096
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


@cache
def _letter() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def counts(text: str | None) -> np.ndarray | None:
    """Hashed counts of the text's 1- to 3-grams; None if it has no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = _letter()[codes] if len(codes) else np.zeros(0, dtype=bool)
    if not letters.any():
        return None
    codes = np.where(letters, codes, np.uint32(32))
    keep = letters.copy()
    keep[1:] |= letters[:-1]  # the first of several other characters stays as the space
    c = np.concatenate([[32], codes[keep], [32]]).astype(np.uint32)
    one, two = c * _A, c[:-1] * _B + c[1:] * _A
    three = c[:-2] * _C + c[1:-1] * _B + c[2:] * _A + np.uint32(1)
    h = np.concatenate([one[c != 32], two, three])
    h ^= h >> np.uint32(15)
    h = h * _B
    return np.bincount((h >> np.uint32(20)).astype(np.int64), minlength=DIMS)


def vectors(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each text, and which texts have letters."""
    x = np.zeros((len(texts), DIMS), dtype=np.float32)
    some = np.zeros(len(texts), dtype=bool)
    for i, t in enumerate(texts):
        c = counts(t)
        if c is not None:
            x[i], some[i] = c, True
    return x, some


def normalised(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = x * idf
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def cluster(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Centroids of at most ``k`` clusters by cosine; starts from rows far from one another."""
    first = x.mean(axis=0)
    near = x @ (first / max(np.linalg.norm(first), 1e-12))
    chosen = [int(near.argmax())]
    close = x @ x[chosen[0]]
    for _ in range(min(k, len(x)) - 1):
        chosen.append(int(close.argmin()))
        close = np.maximum(close, x @ x[chosen[-1]])
    centres = x[chosen]
    for _ in range(rounds):
        label = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[label == j].sum(axis=0) for j in range(len(centres))])
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(size > 0, sums / np.maximum(size, 1e-12), centres)
    return centres


@dataclass(frozen=True)
class CentroidModel:
    languages: tuple[str, ...]
    centroids: np.ndarray
    reach: np.ndarray
    idf: np.ndarray

    def predict(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """doc_id, lang_pred, score (cosine, 0 to 1) and rejected."""
        model = docs.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = model.value
            names = np.array([*m.languages, "und"], dtype=object)
            for b in text_batches(batches, 1 << 20):
                n = b.num_rows
                lang, score, out = np.full(n, len(names) - 1), np.zeros(n), np.ones(n, dtype=bool)
                column = b.column("text")
                for i in range(0, n if m.languages else 0, 500):
                    x, some = vectors(column.slice(i, 500).to_pylist())
                    near = normalised(x, m.idf) @ m.centroids.T
                    best = near.argmax(axis=1)
                    top = near[np.arange(len(x)), best]
                    lang[i:i + 500] = np.where(some, best, lang[i:i + 500])
                    score[i:i + 500] = np.where(some, np.clip(top, 0, 1), 0)
                    out[i:i + 500] = ~some | (top < m.reach[best])
                yield pa.record_batch({"doc_id": b.column("doc_id"), "lang_pred": pa.array(names[lang], pa.string()),
                                       "score": pa.array(score), "rejected": pa.array(out)})

        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Texts with a letter, and in how many of them each dimension occurs: over all of ``docs``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS, dtype=np.int64), 0
        for b in text_batches(batches):
            for t in b.column("text").to_pylist():
                c = counts(t)
                if c is not None:
                    df += c > 0
                    n += 1
        at = np.flatnonzero(df)
        yield pa.record_batch({"dim": pa.array(np.append(at, -1)), "n": pa.array(np.append(df[at], n))})

    # DIMS + 1 sums
    rows = docs.select("text").mapInArrow(run, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(DIMS), 0
    for r in rows:
        if r["dim"] < 0:
            n = r["n"]
        else:
            df[r["dim"]] = r["n"]
    return n, df


def sample(usable: DataFrame, max_docs: int) -> DataFrame:
    """At most ``max_docs`` rows (doc_id, lang, text) of each language: those with the smallest hash of id and text.

    Rows equal in both are one.  All tasks together put out about twice ``max_docs`` hashes of a language, those below a
    share of their range, and the ``max_docs``-th smallest is its cut, so no task gathers more."""
    usable = usable.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1))
    sizes = stage(usable.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")), "langid-sizes")
    below = F.col("h") < F.lit(2.0 ** 64 * max_docs) / F.col("n")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    cuts = usable.select("lang", "h").join(broadcast_if_small(sizes), "lang").where(below).select("lang", "h").distinct() \
        .withColumn("place", place).where(F.col("place") <= max_docs).groupBy("lang").agg(F.max("h").alias("last"))
    cuts = stage(cuts, "langid-cuts")
    return usable.join(broadcast_if_small(cuts), "lang").where(F.col("h") <= F.col("last")).dropDuplicates(["lang", "h"]) \
        .select("doc_id", "lang", "text")


def fit(docs: DataFrame, folds: int = 4, held_out: int = 2, max_docs: int = 6000, clusters: int = 8,
        reject_share: float = 0.002) -> CentroidModel:
    """Learns from text and non-null lang of documents whose crc32(doc_id) mod ``folds`` is not ``held_out``."""
    usable = docs.where(F.col("lang").isNotNull() & (crc_mod("doc_id", folds) != held_out)) \
        .select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    n, df = document_frequencies(usable)
    idf = np.log((1 + n) / (1 + df)) + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches):
            x, some = vectors(b.column("text").to_pylist())
            use = np.flatnonzero(some)
            at = [np.flatnonzero(x[i]) for i in use]
            yield pa.record_batch({
                "doc_id": b.column("doc_id").take(pa.array(use)), "lang": b.column("lang").take(pa.array(use)),
                "dims": pa.array([a.astype("<u2").tobytes() for a in at], pa.binary()),
                "values": pa.array([x[i][a].astype("<f4").tobytes() for i, a in zip(use, at)], pa.binary())})

    def learn(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["doc_id", "dims", "values"])
        x = np.zeros((len(own), DIMS), dtype=np.float32)
        for i, (dims, values) in enumerate(zip(own["dims"], own["values"])):
            x[i, np.frombuffer(dims, "<u2")] = np.frombuffer(values, "<f4")
        x = normalised(x, idf).astype(np.float32)
        c = cluster(x, clusters).astype("<f4")
        top = (x @ c.T).max(axis=1)
        return pd.DataFrame({"lang": own["lang"].iloc[0], "place": np.arange(len(c)), "centroid": [y.tobytes() for y in c],
                             "reach": 0.9 * np.quantile(top, reject_share)})

    rows = sample(usable, max_docs).mapInArrow(run, "doc_id long, lang string, dims binary, values binary") \
        .groupBy("lang").applyInPandas(learn, "lang string, place long, centroid binary, reach double").collect()
    rows = sorted(rows, key=lambda r: (r["lang"], r["place"]))
    languages, reach = [r["lang"] for r in rows], [r["reach"] for r in rows]
    centroids = [np.frombuffer(r["centroid"], "<f4") for r in rows]
    return CentroidModel(tuple(languages), np.array(centroids, dtype=np.float32).reshape(-1, DIMS), np.array(reach),
                         idf.astype(np.float32))
