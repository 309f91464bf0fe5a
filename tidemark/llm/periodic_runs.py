"""Runs of words that repeat with a period, found with suffix trees.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are equal),
of at least ``max(min_length, min_exponent * q)`` words, that no neighbouring word extends.  All
runs of a text are found, whatever their length or period:

1. Words outside every three-word window that occurs ``min_exponent - 1`` times (see ``stretches``)
   lie in no run; each stretch of them becomes one separator that equals nothing else.
2. Ukkonen's algorithm builds the suffix trees of what is left and of its reversal.  Over each
   tree's Euler tour, range minima of string depths give the longest common extension of any two
   places in constant time.
3. The order of the first tree's leaves gives, for both orders of the alphabet, the longest Lyndon
   word at each place: the next place of a smaller (greater) suffix.  Every run holds such a word
   of its period's length; each one is extended in both directions and kept if it is a run.

``runs`` returns for each row ``n_words`` (long), ``runs`` (array of start, length, period by
start, then period; words are numbered from 0) and ``collapsed`` (the words that stay, joined by a space: a
run keeps its first ``period`` words).  A row is one text, worked on in one task: a word of a
repetitive stretch takes a few hundred bytes there, other words a few.  Null, empty and
blank texts have no words and no runs.  Rows are independent, so repeated rows have equal results; an
empty table gives an empty result; kept columns may have any names but those of the results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_batches

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RESULTS = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
#: Values of a block of the range minima.
BLOCK = 32
#: Pairs of places that are compared at once.
AT_ONCE = 1 << 16


class Extensions:
    """Longest common extensions of the suffixes of ``text``, from its suffix tree.

    ``text`` holds symbols from 1; a symbol 0 that ends it is added here, so suffixes are
    numbered up to ``len(text)``.  ``rank[i]`` is the place of suffix ``i`` in sorted order."""

    def __init__(self, text: Sequence[int]):
        symbols = [*text, 0]
        edges, start, end, leaf = _ukkonen(symbols)
        tour, depth = _euler_tour(edges, max(symbols) + 1, start, end)
        suffix = leaf[tour]
        at = np.flatnonzero(suffix >= 0)
        order = suffix[at]
        self.rank = np.empty(len(symbols), dtype=np.int64)
        self.rank[order] = np.arange(len(order))
        self.first = np.empty(len(symbols), dtype=np.int64)
        self.first[order] = at
        self._minima(depth[tour])

    def _minima(self, values: np.ndarray) -> None:
        n = -(-len(values) // BLOCK)
        padded = np.full(n * BLOCK, np.iinfo(np.int32).max, dtype=np.int32)
        padded[:len(values)] = values
        self.blocks = padded.reshape(n, BLOCK)
        self.upto = np.minimum.accumulate(self.blocks, axis=1).ravel()
        self.onwards = np.minimum.accumulate(self.blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [self.blocks.min(axis=1)]
        while 2 << (len(self.levels) - 1) <= n:
            below, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(below[:-half], below[half:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of different places, the number of equal symbols from them on."""
        out = np.empty(len(a), dtype=np.int64)
        for i in range(0, len(a), AT_ONCE):
            out[i:i + AT_ONCE] = self._pairs(a[i:i + AT_ONCE], b[i:i + AT_ONCE])
        return out

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = self.first[a], self.first[b]
        x, y = np.minimum(x, y), np.maximum(x, y)
        p, q = x // BLOCK, y // BLOCK
        out = np.minimum(self.onwards[x], self.upto[y])
        wide = np.flatnonzero(q - p > 1)
        if len(wide):
            low, size = p[wide] + 1, q[wide] - p[wide] - 1
            level = np.frexp(size)[1] - 1
            for k in np.unique(level):
                some = level == k
                table, at = self.levels[k], wide[some]
                both = np.minimum(table[low[some]], table[low[some] + size[some] - (1 << k)])
                out[at] = np.minimum(out[at], both)
        near = np.flatnonzero(p == q)
        if len(near):
            places = np.arange(BLOCK)
            inside = (places >= (x[near] % BLOCK)[:, None]) & (places <= (y[near] % BLOCK)[:, None])
            out[near] = np.where(inside, self.blocks[p[near]], np.iinfo(np.int32).max).min(axis=1)
        return out


def _ukkonen(symbols: list[int]) -> tuple[dict[int, int], np.ndarray, np.ndarray, np.ndarray]:
    """The suffix tree: edges (node times alphabet plus first symbol, to node), the text of each
    node's edge as start and end, and the suffix of each leaf (-1 for other nodes)."""
    n, k = len(symbols), max(symbols) + 1
    edges: dict[int, int] = {}
    start, end, link, leaf = [0], [0], [0], [-1]
    node = edge = length = todo = 0
    for i, c in enumerate(symbols):
        todo += 1
        waits = 0  # an inner node made in this step whose link is not known yet
        while todo:
            if not length:
                edge = i
            key = node * k + symbols[edge]
            to = edges.get(key)
            if to is None:
                edges[key] = len(start)
                start.append(i), end.append(n), link.append(0), leaf.append(i - todo + 1)
                if waits:
                    link[waits] = node
                    waits = 0
            else:
                s = start[to]
                span = (end[to] if end[to] <= i else i + 1) - s
                if length >= span:
                    edge += span
                    length -= span
                    node = to
                    continue
                if symbols[s + length] == c:
                    length += 1
                    if waits:
                        link[waits] = node
                    break
                mid = len(start)
                edges[key] = mid
                start.append(s), end.append(s + length), link.append(0), leaf.append(-1)
                edges[mid * k + c] = mid + 1
                start.append(i), end.append(n), link.append(0), leaf.append(i - todo + 1)
                start[to] = s + length
                edges[mid * k + symbols[s + length]] = to
                if waits:
                    link[waits] = mid
                waits = mid
            todo -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - todo + 1
    return edges, np.array(start), np.array(end), np.array(leaf)


def _euler_tour(edges: dict[int, int], k: int, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes in the order of a walk around the tree, children by first symbol, and each
    node's string depth."""
    nodes = len(start)
    keys = np.fromiter(edges.keys(), np.int64, len(edges))
    to = np.fromiter(edges.values(), np.int64, len(edges))
    order = np.argsort(keys)  # by parent, then symbol
    child = to[order].tolist()
    parent = np.zeros(nodes, dtype=np.int64)
    parent[to] = keys // k
    count = np.bincount(keys // k, minlength=nodes)
    last = np.cumsum(count)
    upto, at, up = last.tolist(), (last - count).tolist(), parent.tolist()
    span, depth = (end - start).tolist(), [0] * nodes
    tour, v = [], 0
    while True:
        tour.append(v)
        i = at[v]
        if i < upto[v]:
            at[v] = i + 1
            w = child[i]
            depth[w] = depth[v] + span[w]
            v = w
        elif v:
            v = up[v]
        else:
            return np.array(tour), np.array(depth, dtype=np.int32)


def lyndon_ends(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place, where the longest Lyndon word that starts there ends, in the alphabet's order
    and in the reverse one: the next place of a smaller and of a greater suffix."""
    n, r = len(rank), rank.tolist()
    smaller, greater = [n] * n, [n] * n
    low: list[int] = []
    high: list[int] = []
    for i, x in enumerate(r):
        while low and r[low[-1]] > x:
            smaller[low.pop()] = i
        low.append(i)
        while high and r[high[-1]] < x:
            greater[high.pop()] = i
        high.append(i)
    return np.array(smaller), np.array(greater)


def maximal_repetitions(text: Sequence[int], min_length: int, min_exponent: int) -> np.ndarray:
    """(start, length, period) rows of the runs of ``text`` (symbols from 1), by start, then period."""
    n = len(text)
    if n < min_length:
        return np.zeros((0, 3), dtype=np.int64)
    ahead = Extensions(text)
    places = np.arange(n)
    smaller, greater = lyndon_ends(ahead.rank)
    i = np.concatenate([places, places])
    j = np.concatenate([smaller[:n], greater[:n]])
    some = j < n
    i, j = i[some], j[some]
    f = ahead(i, j)
    del ahead
    # symbols equal before i and j: extensions of the reversed text
    b = np.zeros(len(i), dtype=np.int64)
    inner = np.flatnonzero(i > 0)
    b[inner] = Extensions(text[::-1])(n - i[inner], n - j[inner])
    period = j - i
    length = period + f + b
    some = length >= np.maximum(min_length, min_exponent * period)
    found = np.stack([i - b, length, period], axis=1)[some]
    found = np.unique(found, axis=0)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def stretches(ids: np.ndarray, min_length: int, min_exponent: int) -> np.ndarray:
    """Which words can lie in a run.

    In a run of period ``q`` and length ``m >= max(min_length, min_exponent * q)`` each window of three
    words occurs ``(m - 2) // q`` times at least: ``min_exponent - 1`` for ``q >= 2`` and ``min_length -
    2`` for ``q = 1``.  Windows seen less often are given up, with stretches too short for a run,
    until that frees no more words."""
    n, least = len(ids), min(min_exponent - 1, min_length - 2)
    keep = np.ones(n, dtype=bool)
    if n < 3 or least < 2:
        return keep
    size = int(ids.max()) + 1
    pairs = ids[:-1].astype(np.int64) * size + ids[1:]
    if size > 2_000_000:  # three of these would not fit into 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
        windows = pairs[:-1] * size + ids[2:]
    else:
        windows = pairs[:-1] * size + ids[2:]
    at = np.arange(n - 2)
    while len(at):
        _, which, count = np.unique(windows[at], return_inverse=True, return_counts=True)
        good = at[count[which] >= least]
        # stretches of successive windows cover two words more than they have windows
        cuts = np.flatnonzero(np.diff(good) != 1) + 1
        first = np.concatenate([[0], cuts])[:len(good)]
        sizes = np.diff(np.concatenate([first, [len(good)]])) if len(good) else np.zeros(0, dtype=np.int64)
        good = good[np.repeat(sizes + 2 >= min_length, sizes)] if len(good) else good
        if len(good) == len(at):
            break
        at = good
    keep[:] = False
    for k in range(3):
        keep[at + k] = True
    return keep


def word_runs(words: Sequence[bytes], min_length: int = 6, min_exponent: int = 4) -> np.ndarray:
    """(start, length, period) rows of all runs of a list of words."""
    none = np.zeros((0, 3), dtype=np.int64)
    if len(words) < min_length:
        return none
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    keep = stretches(ids, min_length, min_exponent)
    if not keep.any():
        return none
    place = np.flatnonzero(keep)
    # a separator before each stretch but the first
    gap = np.flatnonzero(np.diff(place) != 1) + 1
    symbols = np.unique(ids[place], return_inverse=True)[1] + 1
    text = np.insert(symbols, gap, symbols.max() + 1 + np.arange(len(gap)))
    where = np.insert(place, gap, -1)
    found = maximal_repetitions(text.tolist(), min_length, min_exponent)
    found[:, 0] = where[found[:, 0]]
    return found


def runs(docs: DataFrame, keep: Sequence[str] = ("doc_id",), min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """``keep`` of ``docs`` and, of its column ``text``, RESULTS."""
    if min_length < 2 or min_exponent < 2:
        raise ValueError("runs have two periods and two words at least")
    inner = docs.select(*[F.col(c).alias(f"k{i}_") for i, c in enumerate(keep)], F.col("text").alias("text"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches):
            count, found, left = [], [], []
            for text in b.column("text").to_pylist():
                words = (text or "").encode("utf-8", "surrogatepass").split()  # at these six characters only
                some = word_runs(words, min_length, min_exponent)
                count.append(len(words))
                found.append([{"start": s, "length": n, "period": q} for s, n, q in some.tolist()])
                if len(some):
                    stay = np.ones(len(words), dtype=bool)
                    for s, n, q in some.tolist():
                        stay[s + q:s + n] = False
                    words = [words[i] for i in np.flatnonzero(stay)]
                left.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(count, pa.int64()), pa.array(found, pa.list_(RUN)), pa.array(left, pa.string())],
                names=[*b.schema.names[:-1], "n_words", "runs", "collapsed"])

    kept = "".join(f"k{i}_ {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))
    out = inner.mapInArrow(work, kept + RESULTS)
    return out.select(*[F.col(f"k{i}_").alias(c) for i, c in enumerate(keep)], "n_words", "runs", "collapsed")


def top_run(column: str = "runs") -> Column:
    """The run of greatest length / period, compared exactly; ties: smallest start, then period."""
    def better(a: Column, b: Column) -> Column:
        return F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a)

    # in order of start, then period: the first of equals stays
    return F.reduce(F.slice(column, 2, F.greatest(F.size(column) - 1, F.lit(0))), F.get(F.col(column), 0), better)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with repetition written into every text whose id's crc32 is a multiple of ten.

    With ``h`` that crc32, ``g = h / 10`` (floored) and ``n`` words, words from ``a = g % n`` on repeat the ``p = 1 + (n - a)
    / (3 + g % 8)`` words that start there.  Texts without an id stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False)) & (F.length(F.col("text")) > 0)
    words = F.when(chosen, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    d = docs.withColumn("_w", words).withColumn("_n", F.size("_w").cast("long")).withColumn("_g", F.floor(h / 10))
    d = d.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    d = d.withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    times = F.expr("CAST((_n - _a + _p - 1) div _p AS INT)")
    block = F.expr("slice(_w, CAST(_a AS INT) + 1, CAST(_p AS INT))")
    tail = F.slice(F.flatten(F.array_repeat(block, times)), F.lit(1), (F.col("_n") - F.col("_a")).cast("int"))
    head = F.slice("_w", F.lit(1), F.col("_a").cast("int"))
    text = F.when(F.col("_n") > 0, F.array_join(F.concat(head, tail), " ")).otherwise(F.col("text"))
    return d.withColumn("text", text).drop("_w", "_n", "_g", "_a", "_p")
