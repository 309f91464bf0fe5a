"""Quality rules with an isolation forest on their statistics.

Every text is reduced to rule statistics (words, symbols, repeated lines and word windows,
character kinds).  An isolation forest is grown from all labelled rows: each tree draws the few rows
that the method gives it (``sample``) from all of them and splits these at random values of random
statistics; rows that are separated by few splits are anomalies.  A row's anomaly score is ``2 ** (-mean
path length / c)`` with ``c`` the mean path length of an unsuccessful search in such a draw.  The
threshold on the score is calibrated on every labelled row: among the scores it takes the one
that separates the labels best while at least ``keep_share`` of the good rows stay.

A document is kept if it passes the base rules and its score is not above the threshold.
Null texts have no words and fail the base rules.  Rows are judged one by one, so
repeated rows get equal verdicts; an empty table gives an empty result; extra columns of
the input are ignored.  Without labelled rows only the base rules judge.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stage, text_batches

SPACES, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_chars", "n_lines", "n_upper", "n_digits", "n_marks")
_UPPER = str.maketrans("", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = str.maketrans("", "", "0123456789")


def repeated_window_words(words: Sequence[bytes], k: int = 3) -> int:
    """Words that lie in a ``k``-word window found twice or more in the text, first ones included."""
    if len(words) <= k:
        return 0
    windows = list(zip(*[words[i:] for i in range(k)]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    hit, upto = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            hit += i + k - max(i, upto)
            upto = i + k
    return hit


def rule_stats(text: str | None) -> tuple[int, ...]:
    """The statistics of BASE and MORE.  Words are runs of characters other than ``SPACES``."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: splits at exactly these six characters
    spaces = sum(map(text.count, SPACES))
    seen: set[str] = set()
    duplicates = lines = 0
    for line in text.split("\n"):
        if not line or not line.strip(SPACES):
            continue
        lines += 1
        duplicates += line in seen
        seen.add(line)
    ascii_only = raw.decode("ascii", "ignore")
    return (len(words), len(text) - spaces, sum(map(text.count, SYMBOLS)), duplicates, repeated_window_words(words),
            len(text), lines, len(ascii_only) - len(ascii_only.translate(_UPPER)),
            len(ascii_only) - len(ascii_only.translate(_DIGIT)), sum(map(text.count, ".,;:!?")))


#: Limits of the rules, in the units of ``features``.
LIMITS = {"symbols_per_word": 0.1, "duplicate_lines": 0.3, "repeated_words": 0.3, "upper": 0.2, "digits": 0.15,
          "marks_per_word": 0.5, "long_words": 10.0, "short_words": -3.0}


def features(stats: np.ndarray) -> np.ndarray:
    """By how much the statistics (rows of BASE and MORE) exceed each rule's limit, 0 if they do not.

    Ordinary documents meet at 0, where no split can part them, so the forest separates the
    others."""
    (n, chars, symbols, dup, repeat, _, lines, upper, digits, marks) = stats.T.astype(float)
    n1, c1 = np.maximum(n, 1), np.maximum(chars, 1)
    values = np.stack([symbols / n1, dup / np.maximum(lines, 1), repeat / n1, upper / c1, digits / c1, marks / n1,
                       chars / n1, -chars / n1], axis=1)
    return np.maximum(values - np.array(list(LIMITS.values())), 0)


def average_path(n: np.ndarray | float):
    """Mean path length of an unsuccessful search among ``n`` rows of a random search tree."""
    n = np.asarray(n, dtype=float)
    m = np.maximum(n - 1, 1)
    return np.where(n > 2, 2 * (np.log(m) + 0.5772156649015329) - 2 * m / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Forest:
    """Trees as arrays, one row per tree: a node's statistic (-1: leaf), value, children, and for
    leaves their depth plus the expected depth of the rows in them."""

    statistic: np.ndarray
    value: np.ndarray
    left: np.ndarray
    length: np.ndarray
    sample: int
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for k, value, left, length in zip(self.statistic, self.value, self.left, self.length):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = k[node]
                go = at >= 0
                if not go.any():
                    break
                right = x[rows, np.maximum(at, 0)] >= value[node]
                node = np.where(go, left[node] + right, node)
            total += length[node]
        return 2.0 ** (-total / len(self.statistic) / float(average_path(self.sample)))


def grow_forest(x: np.ndarray, trees: int = 200, sample: int = 64, seed: int = 11) -> Forest:
    """Trees on ``sample`` rows each; where there are enough rows for all, no row is in two trees."""
    rng = np.random.default_rng(seed)
    sample = min(sample, len(x))
    apart = rng.permutation(len(x)).reshape(trees, sample) if len(x) == trees * sample else None
    depth = max(1, math.ceil(math.log2(max(sample, 2))))
    size = 2 ** (depth + 1)
    k, value = np.full((trees, size), -1), np.zeros((trees, size))
    left, length = np.zeros((trees, size), dtype=np.int64), np.zeros((trees, size))
    for t in range(trees):
        drawn = rng.choice(len(x), sample, replace=False) if apart is None else apart[t]
        todo, free = [(0, x[drawn], 0)], 1
        while todo:
            node, rows, d = todo.pop()
            low, high = rows.min(axis=0), rows.max(axis=0)
            open_ = np.flatnonzero(high > low)
            if d >= depth or len(rows) < 2 or not len(open_):
                length[t, node] = d + float(average_path(len(rows)))
                continue
            j = int(rng.choice(open_))
            cut = rng.uniform(low[j], high[j])
            cut = high[j] if cut <= low[j] else cut
            k[t, node], value[t, node], left[t, node] = j, cut, free
            right = rows[:, j] >= cut
            todo += [(free, rows[~right], d + 1), (free + 1, rows[right], d + 1)]
            free += 2
    return Forest(k, value, left, length, sample, depth)


def calibrate(scores: np.ndarray, good: np.ndarray, keep_share: float) -> float:
    """The largest score that is kept: rejected rows above it hold as many bad and as few good rows as
    possible (difference of the shares), and at least ``keep_share`` of the good rows are not above."""
    if not good.any() or good.all():
        return 1.0
    cuts = np.unique(scores)
    g, b = np.sort(scores[good]), np.sort(scores[~good])
    kept_good = np.searchsorted(g, cuts, side="right") / len(g)
    kept_bad = np.searchsorted(b, cuts, side="right") / len(b)
    gain = np.where(kept_good >= keep_share, kept_good - kept_bad, -1)
    best = int(np.argmax(gain))
    higher = cuts[best + 1] if best + 1 < len(cuts) else 1.0
    return float((cuts[best] + higher) / 2)


@dataclass(frozen=True)
class RuleModel:
    forest: Forest
    threshold: float

    def judge(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """doc_id, the statistics of BASE, base_failed, anomaly (0 to 1) and kept."""
        model = self

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in text_batches(batches):
                s = np.array([rule_stats(t) for t in b.column("text").to_pylist()], dtype=np.int64)
                yield pa.record_batch({"doc_id": b.column("doc_id"),
                                       **{c: pa.array(s[:, i]) for i, c in enumerate(BASE)},
                                       "anomaly": pa.array(model.forest.scores(features(s)))})

        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        rows = rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", anomaly double")
        failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
        return rows.withColumn("base_failed", failed) \
            .withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= self.threshold))


def _passes(n_words, n_repeat_words):
    """Whether the base rules are met."""
    return (n_words >= 50) & (100 * n_repeat_words <= 50 * n_words)


def labelled_stats(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, good and stats of every labelled id that ``docs`` has.

    Of labels that repeat an id the lowest holds, of texts that do the one with the smallest hash.  Texts
    stay where they are: their statistics are joined."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches):
            s = [list(rule_stats(t)) for t in b.column("text").to_pylist()]
            yield pa.record_batch({"doc_id": b.column("doc_id"), "h": b.column("h"), "stats": pa.array(s, pa.list_(pa.int64()))})

    judged = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")) \
        .agg(F.min("quality").alias("quality"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.where("doc_id IS NOT NULL").withColumn("h", F.xxhash64("text")).mapInArrow(run, "doc_id long, h long, stats array<long>")
    return rows.join(judged, "doc_id").groupBy("doc_id").agg(F.min(F.struct("h", "quality", "stats")).alias("r")) \
        .select("doc_id", (F.col("r.quality") == 1).alias("good"), "r.stats")


def _draw(rows: DataFrame, k: int) -> list:
    """The ``k`` rows of smallest hash; tasks send about twice as many together, not ``k`` each."""
    n, h = rows.count(), F.xxhash64("doc_id")
    if n > 2 * k:
        few = rows.where(h <= F.lit(-2**63 + 2**64 * 2 * k // n))
        rows = few if few.count() >= k else rows
    return rows.orderBy(h, "doc_id").limit(k).collect()


def fit(docs: DataFrame, labels: DataFrame, trees: int = 200, sample: int = 64, keep_share: float = 0.995, seed: int = 11) -> RuleModel:
    """Fits forest and threshold on all labelled rows.

    The forest's ``trees`` * ``sample`` rows are drawn by hash of the id; every row is scored by
    it, and the threshold is found on the scores of all."""
    rows = stage(labelled_stats(docs, labels), "isolation-rows")
    passing = rows.where(_passes(F.col("stats")[0], F.col("stats")[4]))
    # rows that fail the base rules are decided without the forest
    drawn = _draw(passing, trees * sample)
    if not drawn:
        drawn = _draw(rows, trees * sample)
        x = features(np.array([r["stats"] for r in drawn])) if drawn else np.zeros((1, len(LIMITS)))
        return RuleModel(grow_forest(x, trees if drawn else 1, sample, seed), 1.0)
    drawn.sort(key=lambda r: r["doc_id"])
    forest = grow_forest(features(np.array([r["stats"] for r in drawn])), trees, sample, seed)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = features(np.array(b.column("stats").to_pylist(), dtype=np.int64))
                yield pa.record_batch({"anomaly": pa.array(forest.scores(x)), "good": b.column("good")})

    scored = passing.select("stats", "good").mapInArrow(score, "anomaly double, good boolean")
    return RuleModel(forest, calibrate_all(scored, keep_share))


def calibrate_all(scored: DataFrame, keep_share: float) -> float:
    """``calibrate`` over a table (anomaly, good) of any size.

    Scores are dealt to ranges; counts run inside each range and start from those of the ranges before."""
    cuts = scored.groupBy("anomaly").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    cuts = stage(cuts.repartitionByRange("anomaly").withColumn("part", F.spark_partition_id()), "isolation-cuts")
    totals = cuts.agg(F.sum("g").alias("g"), F.sum("b").alias("b")).first()
    if not totals["g"] or not totals["b"]:
        return 1.0
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cuts.groupBy("part").agg(F.sum("g").alias("g"), F.sum("b").alias("b")) \
        .select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in "gb"])
    upto = Window.partitionBy("part").orderBy("anomaly")
    kept = cuts.join(F.broadcast(parts), "part") \
        .select("anomaly", *[((F.sum(c).over(upto) + F.col(f"{c}_before")) / totals[c]).alias(c) for c in "gb"])
    best = kept.where(F.col("g") >= keep_share).withColumn("gain", F.col("g") - F.col("b")) \
        .orderBy(F.col("gain").desc(), "anomaly").first()["anomaly"]
    higher = cuts.where(F.col("anomaly") > best).agg(F.min("anomaly").alias("a")).first()["a"]
    return float((best + (1.0 if higher is None else higher)) / 2)
