"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is labelled good or bad.  Its features are its own statistics and
those of its neighbouring lines; transitions tie neighbouring labels.  Forward-backward gives
each line's probability of being good, and a document's score is their mean weighted by line
length.  A line of a labelled document carries the document's label in training.

The model is fitted on the driver from line statistics (no texts) of at most ``max_docs``
labelled documents of at most ``max_lines`` lines; documents are scored where they lie,
in one pass without a shuffle.

Null texts and texts without a word score 0.  Rows are scored one by one, so repeated rows
get equal scores; an empty table gives an empty result.  Extra columns pass through; a column
named ``score`` of the input is replaced.  Without labels of both classes there is nothing to
learn, and every text with a word scores 0.5.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import crc_mod, text_batches

LOWER, UPPER, DIGIT, SPACE, STOP, BANG, BAR, SYMBOL, OTHER, WIDE = range(10)


def _classes() -> np.ndarray:
    table = np.full(256, OTHER, dtype=np.int64)
    for chars, k in (("abcdefghijklmnopqrstuvwxyz", LOWER), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER),
                     ("0123456789", DIGIT), (" \t\r\v\f", SPACE), (".,;:", STOP), ("!?", BANG), ("|", BAR),
                     ("#$%&*<>=~^_{}[]\\@/+", SYMBOL)):
        table[[ord(c) for c in chars]] = k
    table[0x80:0xC0] = -1  # continuation bytes belong to the character before them
    table[0xC0:] = WIDE
    return table


CLASS = _classes()
#: Statistics of one line; the feature vector is those of the line before, the line and the line after.
STATS = ("words", "word_length", "upper", "digit", "symbol", "bar", "bang", "stop", "other", "wide",
         "distinct", "repetitive", "seen", "many_symbols", "mostly_upper")


def line_stats(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all lines with a word: statistics, lengths in characters; and lines per text."""
    lines: list[str] = []
    distinct, words, seen, per_text = [], [], [], []
    for text in texts:
        known: set[str] = set()
        n = 0
        for line in (text or "").split("\n"):
            w = line.split()
            if not w:
                continue
            n += 1
            lines.append(line)
            words.append(len(w))
            distinct.append(len(set(w)))
            seen.append(line in known)
            known.add(line)
        per_text.append(n)
    if not lines:
        return np.zeros((0, len(STATS))), np.zeros(0), np.array(per_text)
    raw = [x.encode("utf-8", "replace") for x in lines]
    cls = CLASS[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    where = np.repeat(np.arange(len(lines)) * 10, [len(x) for x in raw])
    real = cls >= 0
    c = np.bincount(where[real] + cls[real], minlength=10 * len(lines)).reshape(-1, 10).astype(float)
    length = c.sum(axis=1)
    w, d = np.array(words, dtype=float), np.array(distinct, dtype=float)
    letters = c[:, LOWER] + c[:, UPPER] + c[:, WIDE]
    upper, symbol = c[:, UPPER] / np.maximum(letters, 1), c[:, SYMBOL] / w
    x = np.stack([
        np.log1p(w) / 4, (length - c[:, SPACE]) / w / 10, upper, c[:, DIGIT] / length, np.minimum(symbol, 4) / 2,
        np.minimum(c[:, BAR] / w, 2), np.minimum(c[:, BANG] / w, 2), np.minimum(c[:, STOP] / w, 2),
        np.minimum(c[:, OTHER] / w, 2), c[:, WIDE] / length, d / w, np.log(w / d), np.array(seen, dtype=float),
        (symbol > 0.3).astype(float), (upper > 0.6).astype(float)], axis=1)
    return x, length, np.array(per_text)


def neighbour_features(x: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """1, the line's statistics, and those of the lines before and after it in its text (0 at the ends)."""
    n, k = x.shape
    out = np.zeros((n, 1 + 3 * k))
    out[:, 0] = 1
    out[:, 1:k + 1] = x
    if n > 1:
        text = np.repeat(np.arange(len(per_text)), per_text)
        inside = (text[1:] == text[:-1])[:, None]
        out[1:, k + 1:2 * k + 1] = x[:-1] * inside
        out[:-1, 2 * k + 1:] = x[1:] * inside
    return out


def _steps(per_text: np.ndarray) -> list[np.ndarray]:
    """Row numbers of the t-th lines of all texts, longest texts first."""
    starts = np.concatenate([[0], np.cumsum(per_text)[:-1]])
    order = np.argsort(-per_text, kind="stable")
    counts = per_text[order]
    longest = int(counts[0]) if len(counts) else 0
    alive = np.searchsorted(-counts, -np.arange(longest), side="left")
    return [starts[order[:m]] + t for t, m in enumerate(alive)]


def forward_backward(emit: np.ndarray, trans: np.ndarray, per_text: np.ndarray):
    """Log messages of two-state chains over the lines of each text (state 0 bad, 1 good), where
    ``emit`` is the score of good: returns (alpha, beta, log partition of the line's text)."""
    n = len(emit)
    e = np.stack([np.zeros(n), emit], axis=1)
    alpha, beta = e.copy(), np.zeros((n, 2))
    steps = _steps(per_text)
    for t in range(1, len(steps)):
        now, before = steps[t], steps[t - 1][:len(steps[t])]
        alpha[now] = np.logaddexp(alpha[before, 0, None] + trans[0], alpha[before, 1, None] + trans[1]) + e[now]
    for t in range(len(steps) - 2, -1, -1):
        after = steps[t + 1]
        now = steps[t][:len(after)]
        m = beta[after] + e[after]
        beta[now] = np.logaddexp(m[:, 0, None] + trans[:, 0], m[:, 1, None] + trans[:, 1])
    total = alpha + beta
    return alpha, beta, np.logaddexp(total[:, 0], total[:, 1])


@dataclass(frozen=True)
class CrfModel:
    weights: np.ndarray
    transitions: np.ndarray

    def line_marginals(self, x: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        emit = neighbour_features(x, per_text) @ self.weights
        alpha, beta, z = forward_backward(emit, self.transitions, per_text)
        return np.exp(alpha[:, 1] + beta[:, 1] - z)

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        x, length, per_text = line_stats(texts)
        good = self.line_marginals(x, per_text) if len(x) else np.zeros(0)
        text = np.repeat(np.arange(len(per_text)), per_text)
        sums = np.bincount(text, good * length, minlength=len(per_text))
        return np.clip(sums / np.maximum(np.bincount(text, length, minlength=len(per_text)), 1), 0, 1)

    def score(self, docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
        """``docs`` (the columns ``keep``, all if None) with ``score``."""
        return self._run(docs, text, keep, None)

    def keep_good(self, docs: DataFrame, threshold: float, text: str = "text") -> DataFrame:
        """The rows of ``docs`` whose score is at least ``threshold``, columns unchanged."""
        return self._run(docs, text, docs.columns, threshold)

    def _run(self, docs, text, keep, threshold):
        keep = [c for c in (docs.columns if keep is None else keep) if threshold is not None or c.lower() != "score"]
        model, fields = self, [docs.schema[c] for c in keep]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in text_batches(batches):
                s = pa.array(model.scores(b.column("text").to_pylist()))
                columns = [b.column(f"c{i}") for i in range(len(keep))]
                if threshold is None:
                    yield pa.record_batch(columns + [s], names=[*keep, "score"])
                else:
                    yield pa.record_batch(columns, names=keep).filter(pc.greater_equal(s, threshold))

        rows = docs.select(F.col(text).cast("string").alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)])
        schema = T.StructType([*fields, *([T.StructField("score", T.DoubleType())] if threshold is None else [])])
        return rows.mapInArrow(run, schema)


def fit_crf(x: np.ndarray, per_text: np.ndarray, good: np.ndarray, steps: int = 250, rate: float = 0.1,
            penalty: float = 1e-4) -> CrfModel:
    """Maximum conditional likelihood by full-batch Adam; ``good`` is 0 or 1 per text.

    Texts weigh alike whatever their number of lines."""
    f = neighbour_features(x, per_text)
    y = np.repeat(good, per_text)
    text = np.repeat(np.arange(len(per_text)), per_text)
    share = (1 / np.maximum(per_text, 1) / len(per_text))[text]
    same = text[1:] == text[:-1]
    pairs = np.flatnonzero(same)
    theta = np.zeros(f.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, trans = theta[:-4], theta[-4:].reshape(2, 2)
        emit = f @ w
        alpha, beta, z = forward_backward(emit, trans, per_text)
        p = np.exp(alpha[:, 1] + beta[:, 1] - z)
        grad_w = f.T @ ((p - y) * share)
        grad_t = np.zeros((2, 2))
        e = np.stack([np.zeros(len(emit)), emit], axis=1)
        for a in (0, 1):
            for b in (0, 1):
                joint = np.exp(alpha[pairs, a] + trans[a, b] + e[pairs + 1, b] + beta[pairs + 1, b] - z[pairs])
                seen = (y[pairs] == a) & (y[pairs + 1] == b)
                grad_t[a, b] = ((joint - seen) * share[pairs]).sum()
        g = np.concatenate([grad_w, grad_t.ravel()]) + penalty * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return CrfModel(theta[:-4], theta[-4:].reshape(2, 2))


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 4000, max_lines: int = 2000,
        folds: int = 5, held_out: int = 0) -> CrfModel:
    """Learns from labelled documents whose crc32(doc_id) mod ``folds`` is not ``held_out``.

    ``max_docs`` bounds the sample (the labels with the smallest hash of their id): of rows that repeat an
    id, the text with the smallest hash is learned from, and of a long text its first ``max_lines`` lines."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()
                          & (crc_mod("doc_id", folds) != held_out))
    sample = usable.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_docs) \
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))

    def stats(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches):
            x, _, n = line_stats(b.column("text").to_pylist())
            ends = np.cumsum(n)
            use = [i for i in range(len(n)) if n[i]]
            yield pa.record_batch({
                **{c: b.column(c).take(pa.array(use, pa.int64())) for c in ("doc_id", "quality", "h")},
                "x": pa.array([x[ends[i] - n[i]:ends[i] - n[i] + min(n[i], max_lines)].astype("<f4").tobytes() for i in use], pa.binary())})

    chosen = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")) \
        .join(F.broadcast(sample), "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), F.xxhash64("text").alias("h"), "text")
    # one row of an id leaves each task, so at most max_docs are gathered
    rows = chosen.mapInArrow(stats, "doc_id long, quality int, h long, x binary").groupBy("doc_id") \
        .agg(F.min(F.struct("h", "x", "quality")).alias("r")).select("doc_id", "r.quality", "r.x").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["x"]))
    if {r["quality"] for r in rows} != {0, 1}:
        return CrfModel(np.zeros(3 * len(STATS) + 1), np.zeros((2, 2)))
    x = [np.frombuffer(r["x"], dtype="<f4").reshape(-1, len(STATS)).astype(float) for r in rows]
    return fit_crf(np.concatenate(x), np.array([len(a) for a in x]), np.array([r["quality"] for r in rows]))
