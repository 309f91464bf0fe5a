"""Spelling variants: words one edit apart, grouped under their frequent form.

``near_words`` finds, for every word of a vocabulary, the words at edit distance exactly one (one
code point inserted, deleted or replaced), by dynamic programming over sorted lists:

* Of two words one edit apart, the shorter with ``m`` code points, at least ``m // 2`` first or last ones
  agree.  So the vocabulary is sorted twice, by the words and by the reversed words, and cut
  where the first ``m // 2`` code points change, for every ``m``.  A part that is too large is cut by hashes
  into cells of list and query words, so each task holds a bounded list whatever the vocabulary.
* A sorted list is walked depth by depth, for all queries at once.  Adjacent words with a longest
  common prefix (LCP) beyond the depth share a row of the edit matrix, of which three cells around
  the diagonal matter.  A range whose shared prefix has no cell of at most one edit is left there, with all words in it.
* A pair that agrees at both ends is counted by the forward lists only, so counts of near words add up.

``variant_groups`` adds each word's form (its near word of largest count, if at least ``ratio`` times its own; ties:
the smallest in code-point order), and the root that the forms lead to.  Counts grow along forms, so they end.

Null and empty texts have no words; words may have any length; rows are counted as often as they
occur; an empty table gives an empty result.  ``word_occurrences`` ignores other columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast_if_small, stage

LETTERS = r"A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a part that is not cut into cells, and code points and queries worked on at once; results do not depend on them.
PART_WORDS = 100_000
CHUNK_CODES = 1 << 20
QUERIES = 1 << 14
PARTIAL = "word string, n_near long, form_n long, form string"


def word_occurrences(docs: DataFrame, min_length: int = 1) -> DataFrame:
    """(doc_id, word): each maximal run of LETTERS of at least ``min_length``, with only A-Z lower-cased."""
    low = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    found = F.regexp_extract_all(low, F.lit(rf"([a-zÀ-ÿ]{{{min_length},}})"), F.lit(1))
    return docs.select("doc_id", F.explode(found).alias("word"))


def with_planted_misspellings(words: DataFrame) -> DataFrame:
    """``words`` (doc_id, word) with a code point deleted where 199 divides the crc32 ``h`` of ``<doc_id>:<word>``: the
    one at ``h`` modulo the length.  A null id counts as the empty text."""
    text = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word"))
    at = (F.col("_h") % F.char_length("word")).cast("int")
    cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
    return words.withColumn("_h", F.crc32(text.cast("binary"))) \
        .withColumn("word", F.when(F.col("_h") % 199 == 0, cut).otherwise(F.col("word"))).drop("_h")


def vocabulary(words: DataFrame, min_length: int = 6, min_count: int = 5) -> DataFrame:
    """(word, n) of the words with enough code points and occurrences."""
    return words.where(F.char_length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")) \
        .where(F.col("n") >= min_count)


def _parts(vocab: DataFrame, part_words: int) -> DataFrame:
    """Every word once for each sorted list that it is in: side 0 by word, 1 by reversed word; ``m`` the
    length of the list's shorter words, which are its queries."""
    size = F.char_length("word")
    lists = F.array(*[F.struct((size - k).alias("m"), F.lit(side).alias("side")) for k in (0, 1) for side in (0, 1)])
    rows = vocab.select("word", "n", size.alias("size"), F.explode(lists).alias("l")).select("word", "n", "size", "l.m", "l.side") \
        .where("m > 0").withColumn("sided", F.when(F.col("side") == 0, F.col("word")).otherwise(F.reverse("word")))
    rows = rows.withColumn("part", F.substring("sided", F.lit(1), F.floor(F.col("m") / 2).cast("int")))
    # at most 4 x vocabulary / part_words rows
    large = rows.groupBy("m", "side", "part").count().where(F.col("count") > part_words)
    large = stage(large.select("m", "side", "part", F.ceil(F.col("count") / part_words).cast("int").alias("cells")), "spelling-large")
    rows = rows.join(broadcast_if_small(large), ["m", "side", "part"], "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
    own, others = F.pmod(F.xxhash64("word"), F.col("cells")).cast("int"), F.sequence(F.lit(0), F.col("cells") - 1)
    as_list = F.transform(others, lambda c: F.struct((own * F.col("cells") + c).alias("cell"), F.lit(True).alias("listed"), F.lit(False).alias("query")))
    as_query = F.transform(others, lambda c: F.struct((c * F.col("cells") + own).alias("cell"), F.lit(False).alias("listed"), F.lit(True).alias("query")))
    short = F.col("size") == F.col("m")
    roles = F.when(F.col("cells") == 1, F.array(F.struct(F.lit(0).alias("cell"), F.lit(True).alias("listed"), short.alias("query")))) \
        .when(short, F.concat(as_list, as_query)).otherwise(as_list)
    return rows.select("m", "side", "part", "sided", "n", F.explode(roles).alias("r")).select("m", "side", "part", "r.cell", "sided", "n", "r.listed", "r.query")


def near_words(vocab: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """Of each word of ``vocab`` (word, n; distinct words) that has near words: their number, and the
    count and text of the most frequent (ties: the smallest)."""
    rows = _parts(vocab, part_words).repartition("m", "side", "part", "cell") \
        .sortWithinPartitions("m", "side", "cell", "sided", "listed")
    found = rows.mapInArrow(_walk_partition, PARTIAL)
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")) \
        .select("word", "n_near", (-F.col("b.n")).alias("form_n"), F.col("b.form").alias("form"))


def _walk_partition(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of whole parts, taken in chunks that end where a list or part does."""
    held: list[pa.RecordBatch] = []
    codes = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        codes += pc.sum(pc.utf8_length(b.column("sided"))).as_py()
        if codes >= CHUNK_CODES:
            rows = pa.Table.from_batches(held).combine_chunks()
            cuts = _list_starts(rows, ("m", "side", "cell", "part"))
            end = int(cuts[-1])
            if end:
                yield from _walk_lists(rows.slice(0, end))
            rest = rows.slice(end).combine_chunks()
            held = rest.to_batches()
            codes = pc.sum(pc.utf8_length(rest.column("sided"))).as_py()
    if held:
        yield from _walk_lists(pa.Table.from_batches(held).combine_chunks())


def _list_starts(rows: pa.Table, columns: tuple[str, ...]) -> np.ndarray:
    new = np.zeros(rows.num_rows, dtype=bool)
    new[:1] = True
    for c in columns:
        x = rows.column(c)
        new[1:] |= pc.not_equal(x.slice(1), x.slice(0, rows.num_rows - 1)).to_numpy()
    return np.flatnonzero(new)


def _walk_lists(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    starts = _list_starts(rows, ("m", "side", "cell"))
    for a, z in zip(starts.tolist(), [*starts[1:].tolist(), rows.num_rows]):
        some = rows.slice(a, z - a)
        m, side = some.column("m")[0].as_py(), some.column("side")[0].as_py()
        out = one_edit_words(some.column("sided").to_pylist(), some.column("n").to_numpy(),
                             some.column("listed").to_numpy(), some.column("query").to_numpy(), m, bool(side))
        if out.num_rows:
            yield out


def one_edit_words(sided: list[str], n: np.ndarray, listed: np.ndarray, query: np.ndarray, m: int, reverse: bool) -> pa.RecordBatch:
    """Near words in a sorted list of words of ``m`` or ``m + 1`` code points (reversed words if ``reverse``), as PARTIAL.

    Pairs of a query (of ``m`` code points) and a listed word that share their first ``m // 2`` code points.  A pair of
    two lengths counts for both words, one of equal lengths for the query."""
    shared = m // 2
    words = [w[::-1] for w in sided] if reverse else sided
    text = "".join([w if len(w) > m else w + "\0" for w in sided])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(sided), m + 1)
    long_ = codes[:, m] != 0
    lcp = np.full(len(sided), -1, dtype=np.int64)
    lcp[1:] = np.cumprod(codes[1:] == codes[:-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    # the listed row among equal rows: it comes last
    equal = np.cumsum(lcp <= m) - 1
    listed_row = np.full(int(equal[-1]) + 1, -1, dtype=np.int64)
    listed_row[equal[listed]] = np.flatnonzero(listed)
    starts = {d: np.flatnonzero(lcp < d) for d in range(shared, m + 2)}
    ones, others = [], []
    asked = np.flatnonzero(query)
    for i in range(0, len(asked), QUERIES):
        a, b = _walk(asked[i:i + QUERIES], codes, starts, listed_row, equal, long_, m, shared)
        ones.append(a), others.append(b)
    a, b = np.concatenate([*ones, np.zeros(0, np.int64)]), np.concatenate([*others, np.zeros(0, np.int64)])
    if reverse and len(a):
        # counted by the forward list
        size = m + long_[b]
        same = np.ones(len(a), dtype=bool)
        for k in range(1, shared + 1):
            same &= codes[a, m - k] == codes[b, size - k]
        a, b = a[~same], b[~same]
    two = long_[b]
    a, b = np.concatenate([a, b[two]]), np.concatenate([b, a[two]])
    order = np.empty(len(words), dtype=np.int64)
    order[sorted(range(len(words)), key=words.__getitem__) if reverse else np.arange(len(words))] = np.arange(len(words))
    by = np.lexsort((order[b], -n[b], a))
    a, b = a[by], b[by]
    first = np.flatnonzero(np.diff(a, prepend=-1) != 0)
    count = np.diff(first, append=len(a))
    return pa.RecordBatch.from_arrays(
        [pa.array([words[i] for i in a[first].tolist()], pa.string()), pa.array(count, pa.int64()),
         pa.array(n[b[first]], pa.int64()), pa.array([words[i] for i in b[first].tolist()], pa.string())],
        names=["word", "n_near", "form_n", "form"])


def _walk(asked: np.ndarray, codes: np.ndarray, starts: dict[int, np.ndarray], listed_row: np.ndarray, equal: np.ndarray,
          long_: np.ndarray, m: int, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, listed word) rows one edit apart.

    A state is a query, a range of the list that shares ``depth`` code points, and the edits between them and the
    query's first ``depth - 1``, ``depth``, ``depth + 1`` code points (2: two or more)."""
    found_a, found_b = [], []

    def report(q: np.ndarray, row: np.ndarray) -> None:
        row = listed_row[equal[row]]
        some = row >= 0
        found_a.append(q[some]), found_b.append(row[some])

    q = asked
    node = np.searchsorted(starts[shared], asked, side="right") - 1
    less = np.full(len(q), 1 if shared else 2, dtype=np.int8)
    even, more = np.zeros(len(q), dtype=np.int8), np.ones(len(q), dtype=np.int8)
    for depth in range(shared, m + 2):
        here = starts[depth]
        row = here[node]
        # words that end at this depth are the first rows of their range
        if depth == m:
            some = (even == 1) & ~long_[row]
            report(q[some], row[some])
        if depth == m + 1:
            some = less == 1
            report(q[some], row[some])
            break
        below = starts[depth + 1]
        low = np.searchsorted(below, here)
        high = np.append(low[1:], len(below))
        fan = (high - low)[node]
        state = np.repeat(np.arange(len(q)), fan)
        child = np.arange(len(state)) - np.repeat(np.cumsum(fan) - fan, fan) + low[node][state]
        c = codes[below[child], depth]
        if depth == m:  # words that have ended have no more code points
            some = c != 0
            state, child, c = state[some], child[some], c[some]
        q, less, even, more = q[state], less[state], even[state], more[state]
        # cells for the query's first depth, depth + 1 and depth + 2 code points
        new_less = np.minimum(even + 1, less + (codes[q, depth - 1] != c) if depth else np.int8(2))
        new_even = np.full(len(q), 2, dtype=np.int8)
        if depth + 1 <= m:
            new_even = np.minimum(np.minimum(even + (codes[q, depth] != c), more + 1), new_less + 1)
        new_more = np.full(len(q), 2, dtype=np.int8)
        if depth + 2 <= m:
            new_more = np.minimum(more + (codes[q, depth + 1] != c), new_even + 1)
        keep = (new_less <= 1) | (new_even <= 1) | (new_more <= 1)
        q, node = q[keep], child[keep]
        less, even, more = (np.minimum(x[keep], 2).astype(np.int8) for x in (new_less, new_even, new_more))
    none = np.zeros(0, np.int64)
    return np.concatenate([*found_a, none]), np.concatenate([*found_b, none])


def variant_groups(vocab: DataFrame, ratio: int = 5, part_words: int = PART_WORDS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each word of ``vocab`` (word, n)."""
    near = near_words(vocab, part_words)
    form = F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False))
    every = vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form, F.col("form")).alias("form"),
        F.when(form, F.col("form_n")).alias("form_n"))
    every = stage(every, "spelling-forms")
    roots = every.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the steps; counts grow by the ratio with each step
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        roots = stage(roots.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"),
                                                               F.col("_next").isNotNull().alias("_moved")), "spelling-roots")
        moved = not roots.where("_moved").isEmpty()
        roots = roots.drop("_moved")
        if not moved:
            break
    return every.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
