"""Cross-entropy difference of a target and a background language model.

Two bigram models of the same form are counted from the corpus: one from the documents of
the target domain, one from all others.  Every word and every pair of neighbours has a count of its
own (under a 64-bit hash: among 10 ** 9 different ones about 0.03 share one), so the models grow
with the corpus and are nowhere whole: they live in tables.  The models are matched: the counts of the
larger domain are scaled to the total of the smaller one, and both are smoothed alike, pairs by
words with weight ``BACKING``, words by ``VOCABULARY`` equal shares.

1. Documents are dealt to blocks of about ``BLOCK_BYTES``.  Each block counts its words and pairs and
   deals the counts to parts by their key (``block_counts``).
2. Each part adds up the counts of its keys over all blocks (a key has one count from each) and sends the
   sums back to the blocks that hold the key, unless it occurs in one block only (``sums``).
3. Each block scores its documents by the sums.

A document's score is its mean loss per word under the target model minus the one under the
background model: negative scores are closer to the target.  Each document is scored by models
that have not seen it: its own counts are taken out of the model they went into.  Each word's
loss difference is available from ``token_losses``.  Rows that repeat an id with the same text share a block.

Words are lower-cased runs of letters, digits and ``_``.  Null texts and texts without words
have no losses (null) and score 0.  Rows are scored one by one (equal rows get equal scores); an
empty table gives an empty result; other columns are ignored.  If one of the domains is empty its
model is uniform.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast_if_small, stage, text_batches
from tidemark.llm.prob_minhash import mix

#: Equal shares of the distribution that words are smoothed by, the same for both models.
VOCABULARY = 1 << 18
BACKING = 8.0
#: Text of a block: one task counts and scores it at once.
BLOCK_BYTES = 16 << 20
#: Elements of a list column that go back to Spark at once.
PIECE = 1 << 17
_WORD = re.compile(r"\w+")
_GOLD, _CONTEXT, _END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)
#: Places of the number of all words and of all texts with words; their keys.
_TOTAL, _TEXTS = 0, 1


class Block:
    """The words of a block's texts, and the counts of both domains for its words, text ends and pairs.

    ``keys`` has a 64-bit key for each place of the counts.  A word is a context as often as it occurs
    but does not end a text; the start of a text is one as often as there are texts."""

    def __init__(self, batches: Iterable[pa.RecordBatch], keep: bool = False):
        """``keep`` is needed for the losses: the slices of the texts.  Large arrays are few, narrow and short-lived:
        a worker's memory is what a block takes at its peak."""
        codes: dict[str, int] = {}
        self.slices, word, n, targets = [], [], [], []
        for b in text_batches(batches):
            found = [_WORD.findall((t or "").lower()) for t in b.column("text").to_pylist()]
            word.append(np.array([codes.setdefault(x, len(codes)) for w in found for x in w], dtype=np.int32))
            n.append(np.array([len(w) for w in found], dtype=np.int64))
            targets.append(np.array([bool(x) for x in b.column("is_target").to_pylist()], dtype=bool))
            if keep:
                self.slices.append(b)
        found = b = None
        self.words = len(codes)
        h = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in codes), np.uint64, self.words)
        codes.clear()
        self.word, self.n, target = (np.concatenate([np.zeros(0, t), *x]) for t, x in ((np.int32, word), (np.int64, n), (bool, targets)))
        del word
        self.ends, self.is_target = np.cumsum(self.n), target
        some = self.n > 0
        start, end = (self.ends - self.n)[some], self.ends[some] - 1
        self.before = np.roll(self.word, 1)
        self.before[start] = self.words
        pairs, self.pair = _distinct(self._pairs())
        context = mix(np.append(h, np.uint64(1)) ^ _CONTEXT)
        self.keys = np.concatenate([np.array([_TOTAL, _TEXTS], np.uint64), h, mix(h ^ _END),
                                    mix(context[pairs // (self.words + 1)] + h[pairs % (self.words + 1)] * _GOLD)])
        size, mine, counts = len(pairs), np.repeat(target, self.n), []
        del pairs
        for of_word, of_text in ((mine, target), (~mine, ~target)):
            counts.append(np.concatenate([[of_word.sum(), (some & of_text).sum()], np.bincount(self.word[of_word], minlength=self.words),
                                          np.bincount(self.word[end][of_text[some]], minlength=self.words),
                                          np.bincount(self.pair[of_word], minlength=size)], dtype=np.int32, casting="unsafe"))
        self.target, self.background = counts

    def _pairs(self) -> np.ndarray:
        """A number for each word and the one before it."""
        out = self.before.astype(np.int64)
        out *= self.words + 1
        out += self.word
        return out

    def order(self, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the counts by part, count and key, whatever the order of the texts; the parts, and where each begins
        (and the last one ends).  Equal counts side by side compress well.  Ends that no text here has may occur elsewhere."""
        part = (self.keys % np.uint64(parts)).astype(np.int64)
        n = np.bincount(part)
        some = np.flatnonzero(n)
        code = _code(part, self.target, self.background)
        del part
        return np.lexsort((self.keys, code)).astype(np.int32), some, np.append(0, np.cumsum(n[some]))

    def put(self, shared: pa.Table, parts: int) -> None:
        """Replaces the block's counts by the sums of ``shared`` (rows of ``sums``) where other blocks hold the key too."""
        order, some, ends = self.order(parts)
        first = ends[np.searchsorted(some, shared.column("part").to_numpy())]
        places = shared.column("places").combine_chunks()
        at = order[np.repeat(first, places.value_lengths().to_numpy()) + places.flatten().to_numpy()]
        del order, places
        self.keys, size = None, len(self.keys)
        for c in ("target", "background"):
            total = np.empty(size, np.int64)
            total[:] = getattr(self, c)
            total[at] = shared.column(c).combine_chunks().flatten().to_numpy()
            setattr(self, c, total)

    def losses(self) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        """Each slice of the texts with the text number and the loss under target and background of its words."""
        totals = [float(c[_TOTAL]) for c in (self.target, self.background)]
        smaller, at = min(totals), 0
        for b in self.slices:
            here = slice(at, at + b.num_rows)
            at += b.num_rows
            n, mine = self.n[here], self.is_target[here]
            tokens = slice(int(self.ends[here.start] - n[0]), int(self.ends[here.stop - 1]))
            text = np.repeat(np.arange(b.num_rows), n)
            word, before, pair = self.word[tokens], self.before[tokens], self.pair[tokens]
            if not len(text):
                yield b, text, np.zeros(0), np.zeros(0)
                continue
            # what the text itself has put into its domain's counts
            own_word, own_context, own_pair = _own(text, word, self.words), _own(text, before, self.words + 1), _own(text, pair, len(self.target))
            own_total, mine, out = n[text], mine[text], []
            for counts, total, own in ((self.target, totals[0], mine), (self.background, totals[1], ~mine)):
                words, ends, pairs = np.split(counts[2:], [self.words, 2 * self.words])
                contexts = np.append(words - ends, counts[_TEXTS])
                w, c, p = words[word] - own * own_word, contexts[before] - own * own_context, pairs[pair] - own * own_pair
                scale = smaller / max(total, 1)
                base = (scale * w + 1) / (scale * (total - own * own_total) + VOCABULARY)
                out.append(-np.log((scale * p + BACKING * base) / (scale * c + BACKING)))
            yield b, text, out[0], out[1]


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and each key's place among them.  (``np.unique`` holds three times as much.)"""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), dtype=bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    keys = keys[new]
    place = np.empty(len(order), dtype=np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return keys, place


def _code(of: np.ndarray, target: np.ndarray, background: np.ndarray) -> np.ndarray:
    """Numbers that sort by ``of``, then by both counts as far as these are small."""
    code = of << 16
    code += np.minimum(target, 255) << 8
    code += np.minimum(background, 255)
    return code


def _own(text: np.ndarray, key: np.ndarray, size: int) -> np.ndarray:
    """How often each element's key occurs in its text."""
    k = text * size + key
    order = np.argsort(k, kind="stable")
    s = k[order]
    new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    out = np.empty(len(k), dtype=np.int64)
    out[order] = np.repeat(np.diff(np.append(new, len(s))), np.diff(np.append(new, len(s))))
    return out


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


def _pieces(rows: pa.RecordBatch, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``rows``, whose lists end at ``ends``, in pieces of about ``PIECE`` elements a list column."""
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], PIECE)), [0, rows.num_rows]))
    for i, j in zip(cuts[:-1], cuts[1:]):
        yield rows.slice(i, j - i)


def block_counts(blocks: DataFrame, parts: int) -> DataFrame:
    """block, part and the keys of the part with their counts in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = []

        def texts():
            for b in batches:
                number[:] = [b.column("block")[0].as_py()]
                yield b

        block = Block(texts())
        block.word = block.before = block.pair = None
        order, some, ends = block.order(parts)
        lists = {c: _lists(x[order], ends) for c, x in (("keys", block.keys.view(np.int64)), ("target", block.target), ("background", block.background))}
        del block, order
        yield from _pieces(pa.record_batch({"block": pa.array(np.full(len(some), number[0], np.int64)), "part": pa.array(some), **lists}), ends)

    return blocks.groupBy("block").applyInArrow(run, "block long, part long, keys array<long>, target array<int>, background array<int>")


def sums(counts: DataFrame) -> DataFrame:
    """block, part and the sums over all blocks of those of its keys that other blocks hold too; ``places`` are
    theirs among the keys that the block sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(batches)
        names = ("target", "background")
        lists = {c: part.column(c).combine_chunks() for c in ("keys", *names)}
        ids, begins = part.select(["block", "part"]).combine_chunks(), np.cumsum(np.append(0, lists["keys"].value_lengths().to_numpy()))
        values = {c: lists[c].flatten().to_numpy() for c in names}
        keys = lists.pop("keys").flatten().to_numpy()
        del part
        # one after the other: the places of the keys that other blocks hold too, by key
        order = np.argsort(keys, kind="stable").astype(np.int32)
        keys = keys[order]
        n = np.diff(np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys)))
        del keys
        order, n = order[np.repeat(n > 1, n)], n[n > 1]
        first = np.cumsum(n) - n
        total = [np.repeat(np.add.reduceat(values[c][order], first, dtype=np.int64), n) for c in names]
        del lists, values
        row = np.searchsorted(begins, order, side="right") - 1
        by = np.lexsort((order, _code(row, *total)))
        order, row = order[by], row[by]
        ends = np.searchsorted(row, np.arange(ids.num_rows + 1))
        places = _lists((order - begins[row]).astype(np.int32), ends)
        del order, row
        out = {c: _lists(t[by], ends) for c, t in zip(names, total)}
        del total, by
        yield from _pieces(pa.record_batch({c: ids.column(c).combine_chunks() for c in ("block", "part")} | {"places": places} | out), ends)

    return counts.groupBy("part").applyInArrow(run, "block long, part long, places array<int>, target array<long>, background array<long>")


def _by_block(docs: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work`` on slices of the texts (batch, text number and both losses of every word)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / BLOCK_BYTES))
    # dealt once: the counts and the scores read the same exchange
    blocks = docs.select("doc_id", "text", "is_target", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).alias("block")).repartition(n, "block")

    def run(table: pa.Table, shared: pa.Table) -> pa.Table:
        block = Block(table.to_batches(), keep=True)
        block.put(shared, n)
        return pa.Table.from_batches([work(*x) for x in block.losses()])

    return blocks.groupBy("block").cogroup(sums(block_counts(blocks, n)).groupBy("block")).applyInArrow(run, schema)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, loss_target, loss_background, score for ``docs`` (doc_id, text, is_target)."""

    def work(b: pa.RecordBatch, text: np.ndarray, *losses: np.ndarray) -> pa.RecordBatch:
        words = np.bincount(text, minlength=b.num_rows)
        mean = [np.bincount(text, x, minlength=b.num_rows) / np.maximum(words, 1) for x in losses]
        none = words == 0
        return pa.record_batch({
            "doc_id": b.column("doc_id"), "n_words": pa.array(words.astype(np.int64)),
            "loss_target": pa.array(mean[0], mask=none), "loss_background": pa.array(mean[1], mask=none),
            "score": pa.array(mean[0] - mean[1])})

    return _by_block(docs, work, "doc_id long, n_words long, loss_target double, loss_background double, score double")


def token_losses(docs: DataFrame) -> DataFrame:
    """doc_id, words, losses: each word of ``docs`` (doc_id, text, is_target) with its loss difference."""

    def work(b: pa.RecordBatch, text: np.ndarray, target: np.ndarray, background: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch({
            "doc_id": b.column("doc_id"),
            "words": pa.array([_WORD.findall((x or "").lower()) for x in b.column("text").to_pylist()], pa.list_(pa.string())),
            "losses": _lists(target - background, np.searchsorted(text, np.arange(b.num_rows + 1)))})

    return _by_block(docs, work, "doc_id long, words array<string>, losses array<double>")


def with_target(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with is_target: whether the id is among ``ids`` (doc_id)."""
    ids = stage(ids.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "lm-target")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = docs.join(broadcast_if_small(ids.withColumn("is_target", F.lit(True))), "doc_id", "left")
    return marked.withColumn("is_target", F.coalesce("is_target", F.lit(False)))


def cross_entropy_difference(docs: DataFrame, target: Column | DataFrame) -> DataFrame:
    """Scores of all ``docs`` (doc_id, text); ``target`` tells the documents of the target domain, by a
    condition on the row or by a table of their ids."""
    if isinstance(target, DataFrame):
        rows = with_target(docs, target)
    else:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                           F.coalesce(target, F.lit(False)).alias("is_target"))
    return score(rows)
