"""Near-duplicate classes by ProbMinHash on word shingles.

Texts are lower-cased and cut into words (runs of letters, digits and ``_``); their shingles
of ``k`` consecutive words, weighted by how often they occur, form a probability
distribution.  Two distributions are similar by their probability Jaccard index; with equal
weights that is the ordinary Jaccard index.

1. Every distinct text is signed: each shingle is a Poisson process whose rate is its weight
   and whose random numbers come from the shingle alone; an arrival picks one of ``m``
   registers, and a register keeps the shingle that arrives first.  A process ends as soon as its
   next arrival is later than all registers.  Registers agree with the probability of the index.
2. Registers are joined into bands; texts that share a band's value share a bucket.
3. In each bucket the texts are compared with leaders, not with one another: the first
   leader is the text that shares the most buckets with others (of a group of copies, mostly the
   text that they were made from).  Texts that no chain of links joins to it are put into new
   buckets, by the rare shingles that similar texts must share, and compared with the next
   leaders, ``GROWTH`` times as many each round, until none is left.  So a bucket of thousands of
   copies costs one comparison for each, and a passage that many texts hold makes no pairs.
   A text may be similar to a joined text only, and not to its leader: at the end texts of different
   classes that still share a bucket are compared directly (``_across``), joined ones too.
4. Compared pairs are verified on their exact shingle weights: they are linked if their probability
   Jaccard index, or the plain Jaccard index of their shingle sets, is at least the threshold.
5. Classes are the connected components of the links, found by joins; a class is
   named by its smallest doc_id.

Texts with the same words form a class without any comparison.  A text of one to ``k`` - 1 words
is one shingle.  Texts without a word are equal if they are the same string (null counts as
empty).  Rows that repeat an id belong to the class of their own text; rows without an id are
classed with equal texts only.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast_if_small, in_few, shielded, stage, text_batches

SHINGLE, THRESHOLD = 5, 0.8
#: Two texts of similarity 0.8 miss each other with probability (1 - 0.8 ** ROWS) ** BANDS = 3e-5.
BANDS, ROWS = 44, 7
#: By how much the number of leaders grows from round to round.
GROWTH = 4
#: Pairs of texts that one task compares.
PAIR_ROWS = 1 << 13
_WORD = re.compile(r"\w+")
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingles(texts: Sequence[str | None], k: int = SHINGLE):
    """(text number, shingle, weight) of the distinct shingles, in order of text and shingle;
    and a 64-bit key of each text's words (of the string itself if it has none)."""
    codes: dict[str, int] = {}
    flat: list[int] = []
    n = np.zeros(len(texts), dtype=np.int64)
    keys = np.zeros(len(texts), dtype=np.uint64)
    for i, text in enumerate(texts):
        words = _WORD.findall((text or "").lower())
        if not words:
            keys[i] = xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass"), 1)
            continue
        n[i] = len(words)
        keys[i] = xxhash.xxh3_64_intdigest("\n".join(words).encode("utf-8", "surrogatepass"))
        flat.extend([codes.setdefault(w, len(codes)) for w in words])
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in codes), np.uint64, len(codes))
    words = hashes[np.array(flat, dtype=np.int64)] if flat else np.zeros(0, np.uint64)
    starts = np.concatenate([[0], np.cumsum(n)])[:-1]
    count = np.where(n == 0, 0, np.maximum(n - k + 1, 1))
    text = np.repeat(np.arange(len(texts)), count)
    first = np.repeat(starts - np.concatenate([[0], np.cumsum(count)])[:-1], count) + np.arange(count.sum())
    length = np.minimum(n, k)[text]
    h = np.zeros(len(text), dtype=np.uint64)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    for j in range(k):
        h = mix(h * _GOLD + np.where(length > j, padded[first + j], np.uint64(j + 1)))
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], h[at], np.diff(np.append(at, len(h))).astype(float), keys


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """``n`` x ``m`` registers with the shingle that arrives first in each."""
    registers, winner = np.full(n * m, np.inf), np.zeros(n * m, dtype=np.uint64)
    time = np.zeros(len(text))
    state = mix(shingle ^ _GOLD)
    total = np.bincount(text, weight, minlength=n)
    rate = weight / np.maximum(total, 1)[text] if len(text) else weight
    while len(text):
        state = mix(state + _GOLD)
        time = time - np.log1p(-((state >> np.uint64(11)).astype(float) / (1 << 53))) / rate
        state = mix(state + _GOLD)
        slot = text * m + (state % np.uint64(m)).astype(np.int64)
        np.minimum.at(registers, slot, time)
        won = registers[slot] == time
        winner[slot[won]] = shingle[won]
        # processes past the latest register of their text can change nothing any more
        active = np.unique(text)
        latest = registers.reshape(n, m)[active].max(axis=1)
        on = time < latest[np.searchsorted(active, text)]
        text, shingle, rate, time, state = text[on], shingle[on], rate[on], time[on], state[on]
    return winner.reshape(n, m)


def bands_of(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 63-bit value of each band of ``rows`` registers; equal values in different bands differ."""
    n, m = signature.shape
    out = np.zeros((n, m // rows), dtype=np.uint64)
    for j in range(rows):
        out = mix(out * _GOLD + signature[:, j::rows][:, :m // rows])
    return mix(out + np.arange(m // rows, dtype=np.uint64)) >> np.uint64(1)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Probability Jaccard and plain Jaccard index of two (sorted shingles, weights)."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    plain = len(common) / max(len(a[0]) + len(b[0]) - len(common), 1)
    if not len(common):
        return 0.0, 0.0
    if (a[1] == 1).all() and (b[1] == 1).all():
        return plain, plain
    # sum over common x of 1 / sum over y of max(a(y) / a(x), b(y) / b(x)): y by the order of a(y) / b(y)
    every = np.union1d(a[0], b[0])
    wa, wb = np.zeros(len(every)), np.zeros(len(every))
    wa[np.searchsorted(every, a[0])] = a[1]
    wb[np.searchsorted(every, b[0])] = b[1]
    with np.errstate(divide="ignore"):
        ratio = np.where(wb > 0, wa / np.maximum(wb, 1e-300), np.inf)
    order = np.argsort(ratio, kind="stable")
    below_b = np.concatenate([[0], np.cumsum(wb[order])])
    above_a = wa.sum() - np.concatenate([[0], np.cumsum(wa[order])])
    x, y = a[1][i], b[1][j]
    cut = np.searchsorted(ratio[order], x / y)
    return float((1 / (above_a[cut] / x + below_b[cut] / y)).sum()), plain


def sign(docs: DataFrame, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, _h (hash of the text), _key (of the words), bands (empty if the text has no word)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches):
            text, shingle, weight, keys = shingles(b.column("text").to_pylist(), k)
            n = b.num_rows
            values = bands_of(signatures(text, shingle, weight, n, bands * rows), rows).astype(np.int64)
            some = np.bincount(text, minlength=n) > 0
            offsets = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)
            yield pa.record_batch({
                "doc_id": b.column("doc_id"), "_h": b.column("_h"), "_key": pa.array(keys.view(np.int64)),
                "bands": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[some].ravel()))})

    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows_.withColumn("_h", F.xxhash64("text")).mapInArrow(run, "doc_id long, _h long, _key long, bands array<long>")


def _shingle_sets(texts: DataFrame, k: int) -> DataFrame:
    """_key, shingles (sorted 64-bit values), weights: as binary."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches):
            text, shingle, weight, keys = shingles(b.column("text").to_pylist(), k)
            ends = np.searchsorted(text, np.arange(b.num_rows + 1))
            spans = list(zip(ends[:-1], ends[1:]))
            yield pa.record_batch({
                "_key": pa.array(keys.view(np.int64)),
                "shingles": pa.array([shingle[i:j].tobytes() for i, j in spans], pa.binary()),
                # all ones: nothing is stored
                "weights": pa.array([b"" if (weight[i:j] == 1).all() else weight[i:j].astype("<f4").tobytes()
                                     for i, j in spans], pa.binary())})

    return texts.select("text").mapInArrow(run, "_key long, shingles binary, weights binary")


def _read_set(shingle: bytes, weight: bytes) -> tuple[np.ndarray, np.ndarray]:
    s = np.frombuffer(shingle, dtype=np.uint64)
    return s, np.frombuffer(weight, dtype="<f4").astype(float) if weight else np.ones(len(s))


def _slices(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of pairs of sets, few at once."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def _verify(threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            cols = [batch.column(c).to_pylist() for c in ("a", "b", "sa", "wa", "sb", "wb")]
            # sets without weights are at most as similar as their sizes
            ok = [(bool(wa or wb) or min(len(sa), len(sb)) >= (threshold - 1e-9) * max(len(sa), len(sb)))
                  and max(similarity(_read_set(sa, wa), _read_set(sb, wb))) >= threshold for _, _, sa, wa, sb, wb in zip(*cols)]
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b"), "linked": pa.array(ok, pa.bool_())})
    return run


def links(signed: DataFrame, docs: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """a, b (keys, a < b) of verified pairs that connect all similar texts of each bucket."""
    n = signed.agg(F.sum(F.greatest(F.size("bands"), F.lit(1))).alias("n")).first()["n"] or 0
    buckets = in_few(signed.where(F.size("bands") > 0).dropDuplicates(["_key"]), n).select("_key", F.explode("bands").alias("band"))
    sizes = in_few(buckets.groupBy("band").agg(F.count(F.lit(1)).alias("n")), n).where("n > 1")
    members = stage(in_few(buckets.join(sizes, "band"), n), "minhash-buckets")
    n = members.count()
    wanted = stage(in_few(members.groupBy("_key").agg(F.sum("n").alias("mates")), n), "minhash-wanted")
    members = stage(members.drop("n").join(broadcast_if_small(wanted), "_key"), "minhash-members")
    ids = signed.join(broadcast_if_small(wanted.select("_key")), "_key", "left_semi").groupBy("_key").agg(F.min("doc_id").alias("doc_id"))
    ids = in_few(ids, n)
    texts = docs.select("doc_id", "text").join(broadcast_if_small(stage(ids.select("doc_id"), "minhash-ids")), "doc_id", "left_semi")
    sets = stage(_shingle_sets(texts, k).join(broadcast_if_small(wanted.select("_key")), "_key", "left_semi"), "minhash-sets")
    if sets.count() > wanted.count():  # rows that repeat an id
        sets = stage(sets.dropDuplicates(["_key"]), "minhash-sets")
    members = members.withColumn("label", F.col("_key")).withColumn("light", F.lit(True))
    every = members
    found, tested, leaders = None, None, 1
    while True:
        n = members.count()
        lead = in_few(_leaders(members, leaders), n)
        # every leader comes before the other members that may lead, in the order that they are picked by
        after = ~F.col("light") | (F.col("mates") < F.col("lead_mates")) | ((F.col("mates") == F.col("lead_mates")) & (F.col("_key") > F.col("leader")))
        met = in_few(members.join(lead, "band").where(after & (F.col("label") != F.col("lead_label"))), n * leaders)
        pairs = in_few(met.select(F.least("_key", "leader").alias("a"), F.greatest("_key", "leader").alias("b")).distinct(), n * leaders)
        if tested is not None:
            pairs = in_few(pairs.join(tested, ["a", "b"], "left_anti"), n * leaders)
        pairs = stage(pairs, "minhash-pairs")
        done = _verified(pairs, sets, threshold)
        linked = done.where("linked").select("a", "b")
        found = linked if found is None else found.union(linked)
        tested = done.select("a", "b") if tested is None else tested.union(done.select("a", "b"))
        rest = stage(_still_apart(members, lead, found, n), "minhash-rest")
        if rest.isEmpty():
            return _across(every, sets, found, threshold)
        if leaders == 1:  # the texts of all buckets together; their new buckets hold every similar pair of them
            rest = stage(_prefix_buckets(sets, rest, threshold), "minhash-prefixes")
        members, leaders = rest, leaders * GROWTH


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """a, b and linked of ``pairs`` (a staged table)."""
    n = pairs.count()
    a = sets.select(F.col("_key").alias("a"), F.col("shingles").alias("sa"), F.col("weights").alias("wa"))
    b = sets.select(F.col("_key").alias("b"), F.col("shingles").alias("sb"), F.col("weights").alias("wb"))
    full = in_few(in_few(pairs.join(a, "a"), n, PAIR_ROWS).join(b, "b"), n, PAIR_ROWS).select("a", "b", "sa", "wa", "sb", "wb")
    return stage(full.mapInArrow(_verify(threshold), "a long, b long, linked boolean"), "minhash-verified")


def _across(members: DataFrame, sets: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """``found`` and the links between texts of different classes that share a bucket.

    All texts of buckets with two or more classes get prefix buckets, joined ones too.  In each, the texts outside
    its largest class are compared with the stars of other classes: a star is a leader and the texts linked to it.  Both
    distances (one less the index) are metrics, so a text further from a leader than the greatest distance of a member and
    that of a link has no link into the star.  Stars that stay in question are searched by ``_into_stars``."""
    n = members.count()
    roots = broadcast_if_small(stage(components(found), "minhash-roots"))
    relabel = lambda df, key, label, roots: df.join(roots.select(F.col("node").alias(key), F.col("root").alias(label)), key, "left") \
        .withColumn(label, F.coalesce(label, key))
    rest = stage(_open_buckets(relabel(members.drop("label"), "_key", "label", roots), n), "minhash-mixed")
    if rest.isEmpty():
        return found
    items = _prefix_buckets(sets, rest, threshold).select("_key", "band", "label", "light")
    items = stage(items, "minhash-mixed-items")
    n = items.count()
    items = in_few(items.join(_stars(found), "_key", "left"), n).withColumn("star", F.coalesce("star", "_key"))
    items = stage(items, "minhash-mixed-prefixes")
    sizes = in_few(items.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n")), n)
    largest = in_few(sizes.groupBy("band").agg(F.max_by("label", F.struct("n", "label")).alias("largest")), n)
    few = in_few(items.join(largest, "band"), n).where("label != largest") \
        .select("band", F.col("_key").alias("x"), F.col("label").alias("x_label"), F.col("light").alias("x_light"))
    few = broadcast_if_small(stage(few, "minhash-few"))
    spots = in_few(items.groupBy("band", "star", "label").agg(F.max("light").alias("light")), n)
    near = spots.join(few, "band").where((F.col("label") != F.col("x_label")) & (F.col("light") | F.col("x_light")))
    near = stage(near.select("x", "star").distinct(), "minhash-near-stars")
    n_near = near.count()
    members = in_few(in_few(items.select("_key", "star").distinct(), n).join(near.select("star"), "star", "left_semi"), n)
    members = stage(_against_leaders(members.where("_key != star"), sets), "minhash-star-members")
    radius = in_few(members.groupBy("star").agg(F.max("far").alias("far"), F.max("far_p").alias("far_p")), members.count())
    near = _against_leaders(near.select(F.col("x").alias("_key"), "star"), sets)
    near = in_few(near.join(radius.withColumnsRenamed({"far": "r", "far_p": "r_p"}), "star", "left"), n_near, PAIR_ROWS)
    reach = 1 - threshold + 1e-9
    is_open = (F.col("far") <= F.col("r") + reach) | (F.col("far_p") <= F.col("r_p") + reach)
    linked = F.least("far", "far_p") <= reach
    near = stage(near.select("*", linked.alias("linked"), F.coalesce(is_open, F.lit(False)).alias("open")).drop("r", "r_p"), "minhash-near")
    pair = lambda df, y: df.select(F.least("_key", y).alias("a"), F.greatest("_key", y).alias("b"))
    found = found.union(pair(near.where("linked"), "star"))
    near = near.where("open AND NOT linked").drop("linked", "open")
    pairs = stage(relabel(_into_stars(near, members, threshold), "y", "label", roots), "minhash-mixed-pairs")
    if pairs.isEmpty():
        return found
    n = pairs.count()
    place = F.row_number().over(Window.partitionBy("_key", "label").orderBy(F.col("shared").desc(), "y"))
    best = in_few(pair(in_few(pairs.withColumn("place", place), n).where(F.col("place") <= GROWTH), "y").distinct(), n)
    done = _verified(stage(best, "minhash-best"), sets, threshold)
    found = found.union(done.where("linked").select("a", "b"))
    roots = broadcast_if_small(stage(components(found), "minhash-roots"))
    left = relabel(relabel(in_few(pair(pairs, "y").distinct(), n), "a", "_la", roots), "b", "_lb", roots).where("_la != _lb")
    left = in_few(left.select("a", "b").join(done.select("a", "b"), ["a", "b"], "left_anti"), n)
    done = _verified(stage(left, "minhash-left-pairs"), sets, threshold)
    return found.union(done.where("linked").select("a", "b"))


def _stars(found: DataFrame) -> DataFrame:
    """_key, star: of each linked text and those linked to it, the one with the most links."""
    rows = 2 * found.count()
    both = in_few(found.union(found.select("b", "a")).toDF("u", "v").distinct(), rows)
    links_ = in_few(both.groupBy("u").agg(F.count(F.lit(1)).alias("n")), rows)
    of_v = links_.select(F.col("u").alias("v"), F.col("n").alias("n_v"))
    best = in_few(both.join(of_v, "v"), rows).groupBy("u").agg(F.max(F.struct(F.col("n_v").alias("n"), F.col("v").alias("key"))).alias("best"))
    best = in_few(best, rows)
    own = F.struct(F.col("n"), F.col("u").alias("key"))
    return in_few(best.join(links_, "u"), rows).select(F.col("u").alias("_key"), F.greatest("best", own)["key"].alias("star"))


#: Members of a star that meet its leader's set in one task.
STAR_ROWS = 500


def _against_leaders(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Texts (_key, star) compared with their star's leader: its distances ``far`` (plain) and ``far_p`` (probability), the
    number ``n`` of the text's shingles, their total weight ``w``, and ``delta``, the shingles that only one of the two has."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            far, far_p, n, w, delta = [], [], [], [], []
            for sa, wa, sb, wb in zip(*[batch.column(c).to_pylist() for c in ("sa", "wa", "sb", "wb")]):
                x, y = _read_set(sa, wa), _read_set(sb, wb)
                index_p, index = similarity(x, y)
                far.append(1 - index), far_p.append(1 - index_p), n.append(len(x[0])), w.append(float(x[1].sum()))
                delta.append(np.setxor1d(x[0], y[0], assume_unique=True).view(np.int64))
            yield pa.record_batch({
                "_key": batch.column("_key"), "star": batch.column("star"), "far": pa.array(far, pa.float64()), "far_p": pa.array(far_p, pa.float64()),
                "n": pa.array(n, pa.int64()), "w": pa.array(w, pa.float64()), "delta": pa.array(delta, pa.list_(pa.int64()))})

    rows = stage(rows, "minhash-star-rows")
    m = rows.count()
    counts = in_few(rows.groupBy("star").agg(F.ceil(F.count(F.lit(1)) / STAR_ROWS).cast("int").alias("salts")), m)
    leaders = in_few(sets.join(counts, sets._key == counts.star), m, PAIR_ROWS).select(
        "star", F.col("shingles").alias("sb"), F.col("weights").alias("wb"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    texts = in_few(rows.join(counts, "star"), m).withColumn("salt", F.pmod(F.col("_key"), F.col("salts")).cast("int"))
    texts = in_few(texts.join(sets.select("_key", F.col("shingles").alias("sa"), F.col("weights").alias("wa")), "_key"), m, PAIR_ROWS)
    return in_few(texts.join(leaders, ["star", "salt"]), m, PAIR_ROWS).select("_key", "star", "sa", "wa", "sb", "wb") \
        .mapInArrow(run, "_key long, star long, far double, far_p double, n long, w double, delta array<long>")


def _into_stars(near: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(_key, y, shared): the members ``y`` of a star that a text near it may be linked to.

    Two texts differ by the shingles that only one of their deltas to a common leader holds.  Linked by the plain index,
    ``x`` and ``y`` differ by ``most`` shingles at most: (1 - t) / (1 + t) of both counts.  Linked by the probability index, by
    that share of twice the greater total weight, and their distances to the leader are as close as a link.
    Where the delta of ``x`` exceeds that (it is not linked to the leader), the two deltas must share
    ``need = (|dx| + |dy| - most) / 2`` shingles, and so must their rarest ones: with a common order, those
    but the last ``need - 1`` of each.  Edits of one copy only, in no other delta, are the rarest and meet nobody.

    The few texts whose delta does not exceed ``most`` meet the members whose delta is as long as theirs, within
    ``most``; for them members are parted by size and weight."""
    share, reach = (1 - threshold) / (1 + threshold), 1 - threshold + 1e-9
    step = lambda c: F.floor(F.log(F.greatest(F.col(c), F.lit(1))) / F.log(F.lit(1.02))).cast("long")
    members = members.withColumnRenamed("_key", "y").withColumn("m", F.size("delta")).withColumn("part", step("n") * 100_000 + step("w"))
    n_near, n_members = near.count(), members.count()
    members = in_few(members.join(near.select("star"), "star", "left_semi"), n_members, PAIR_ROWS)
    parts = members.groupBy("star", "part").agg(F.max("n").alias("n_y"), F.max("w").alias("w_y"), F.max("far_p").alias("r_p"),
                                                F.min("m").alias("m_low"), F.max("m").alias("m_high"))
    parts = in_few(parts, n_members)
    plain = lambda n, n_x: share * (n + n_x) + 1e-6
    weighted = lambda close, w, w_x: F.when(close, 2 * share * F.greatest(w, w_x) + 1e-6).otherwise(0.0)
    x = near.select("_key", "star", F.col("n").alias("n_x"), F.col("w").alias("w_x"), F.col("far_p").alias("far_x"), "delta", F.size("delta").alias("m_x"))
    x = x.join(parts, "star").withColumn("most", F.greatest(plain(F.col("n_y"), F.col("n_x")), weighted(F.col("far_x") <= F.col("r_p") + reach, F.col("w_y"), F.col("w_x"))))
    # the deltas' sizes alone rule out the other parts
    x = stage(x.where((F.col("m_x") <= F.col("m_high") + F.col("most")) & (F.col("m_low") <= F.col("m_x") + F.col("most"))).drop("n_y", "w_y", "r_p"),
              "minhash-near-parts")
    most = F.greatest(plain(F.col("n"), F.col("n_x")), weighted(F.abs(F.col("far_p") - F.col("far_x")) <= reach, F.col("w"), F.col("w_x")))
    any_ = x.where("m_x <= most").select("_key", "star", "part", "n_x", "w_x", "far_x", "m_x") \
        .join(members.select("y", "star", "part", "n", "w", "far_p", "m"), ["star", "part"]) \
        .where((F.col("m_x") <= most) & (F.abs(F.col("m") - F.col("m_x")) <= most))
    # the deltas' shingles, once for each star: the places that a pair may share are tested by its own sizes
    n_x = x.count()
    x = x.groupBy("_key", "star").agg(F.max("most").alias("most"), *[F.first(c).alias(c) for c in ("n_x", "w_x", "far_x", "m_x", "delta")])
    x = in_few(x, min(n_x, n_near), PAIR_ROWS)
    e_x = x.select("_key", "star", "n_x", "w_x", "far_x", "m_x", F.greatest(F.ceil(F.col("m_x") - F.col("most")), F.lit(1)).alias("need"), F.explode("delta").alias("e"))
    e_y = members.select("y", "star", "n", "w", "far_p", "m", F.explode("delta").alias("e"))
    e_x, e_y = stage(e_x, "minhash-near-deltas"), stage(e_y, "minhash-star-deltas")
    # a shingle of one side only meets nobody; it still takes its place in the order
    spots = ["star", "e"]
    n = e_x.count() + e_y.count()
    held = in_few(e_x.groupBy(*spots).agg(F.count(F.lit(1)).alias("k_x")), n).join(in_few(e_y.groupBy(*spots).agg(F.count(F.lit(1)).alias("k_y")), n), spots)
    held = stage(in_few(held, n).select(*spots, (F.col("k_x") + F.col("k_y")).alias("k")), "minhash-held")

    def placed(df: DataFrame, key: str, m: str) -> DataFrame:
        """The shared shingles with their place in the order of the delta: unshared ones come first."""
        shared = in_few(df.join(held, spots), n)
        own = Window.partitionBy(key, "star")
        return shared.withColumn("at", F.col(m) - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("k", "e")))

    x_side = in_few(placed(e_x, "_key", "m_x"), n).where("at <= m_x - need + 1").drop("need", "k").withColumnRenamed("at", "at_x")
    y_side = in_few(placed(e_y, "y", "m"), n).where("at <= m - floor(m / 2)").drop("k")
    met = stage(x_side, "minhash-near-prefixes").join(stage(y_side, "minhash-star-prefixes"), spots)
    room = 1 + F.least(F.col("m") - F.col("at"), F.col("m_x") - F.col("at_x"))
    # the first shingle that they share lies early enough for all that they need
    met = met.where(2 * room >= F.col("m") + F.col("m_x") - most).groupBy("_key", "y").agg(F.count(F.lit(1)).alias("shared"))
    pairs = met.union(any_.select("_key", "y", F.lit(0).cast("long").alias("shared")))
    return pairs.groupBy("_key", "y").agg(F.max("shared").alias("shared"))


def _prefix_buckets(sets: DataFrame, rest: DataFrame, threshold: float) -> DataFrame:
    """New buckets for the texts that are left: those that share a shingle of their prefix.

    Shingles are ordered by the number of these texts that hold them; a text's prefix is its rarest
    shingles up to a mass of 1 - ``threshold``.  Similar texts share that much mass that their prefixes
    meet (both indexes are at most the common mass), while texts with only a frequent passage in common do not."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, shingle, weight in zip(*[b.column(c).to_pylist() for c in ("_key", "shingles", "weights")]):
                s, w = _read_set(shingle, weight)
                yield pa.record_batch({"_key": pa.array(np.full(len(s), key, dtype=np.int64)), "band": pa.array(s.view(np.int64)),
                                       "p": pa.array(w / w.sum()), "u": pa.array(np.full(len(s), 1 / len(s)))})

    labels = in_few(rest.select("_key", "label").distinct(), rest.count())
    items = sets.join(broadcast_if_small(stage(labels, "minhash-left")), "_key", "left_semi") \
        .mapInArrow(run, "_key long, band long, p double, u double")
    items = stage(items, "minhash-items")
    rows = items.count()
    items = in_few(items.join(in_few(items.groupBy("band").agg(F.count(F.lit(1)).alias("n")), rows), "band"), rows)
    before = Window.partitionBy("_key").orderBy("n", "band").rowsBetween(Window.unboundedPreceding, -1)
    # with a = own / common mass of one text and b of the other, both indexes are at most 1 / (1 + a + b);
    # so one of two similar texts has an own mass of at most ``half`` and leads where its prefix up to that
    # mass meets the other's.  A shingle that no other of these texts holds is own mass
    half = (1 / threshold - 1) / (1 / threshold + 1) + 1e-9
    own = lambda c: F.sum(F.when(F.col("n") == 1, F.col(c)).otherwise(0.0))
    light = in_few(items.groupBy("_key").agg((F.least(own("p"), own("u")) <= half).alias("light")), rows)
    items = in_few(items.withColumn("p", F.sum("p").over(before)).withColumn("u", F.sum("u").over(before)), rows)
    mass = F.coalesce(F.least("p", "u"), F.lit(0.0))
    items = items.where((mass <= 1 - threshold + 1e-9) & (F.col("n") > 1))
    items = stage(items.select("_key", "band", "n", (mass <= half).alias("short")), "minhash-prefix-items")
    # a bucket whose texts all have the same shingle before this one lies inside that one's bucket
    rows = items.count()
    previous = in_few(items.withColumn("prev", F.lag("band").over(Window.partitionBy("_key").orderBy("n", "band"))), rows)
    inside = previous.groupBy("band").agg(F.count(F.lit(1)).alias("all"), F.count("prev").alias("some"),
                                          F.min("prev").alias("x"), F.max("prev").alias("y")).where("all = some and x = y")
    items = stage(in_few(items.join(in_few(inside.select("band"), rows), "band", "left_anti"), rows), "minhash-outer-items")
    mates = in_few(items.groupBy("_key").agg(F.sum("n").alias("mates")).join(labels, "_key").join(light, "_key"), rows)
    members = in_few(items.join(mates, "_key"), rows).withColumn("light", F.col("light") & F.col("short"))
    return _open_buckets(members.select("_key", "band", "mates", "label", "light"), rows)


def _open_buckets(members: DataFrame, rows: int) -> DataFrame:
    """The members (``rows`` at most) of buckets with two or more labels and a text that may lead."""
    many = members.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max("light").alias("light")) \
        .where("x < y and light").select("band")
    return in_few(members.join(in_few(many, rows), "band", "left_semi"), rows)


def _leaders(members: DataFrame, leaders: int) -> DataFrame:
    """The ``leaders`` members of each bucket that share the most buckets with others.  The limit is
    applied before the shuffle."""
    w = Window.partitionBy("band").orderBy(F.col("mates").desc(), "_key")
    return members.where("light").withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= leaders) \
        .select("band", F.col("_key").alias("leader"), F.col("label").alias("lead_label"), F.col("mates").alias("lead_mates"))


def _labels(found: DataFrame) -> DataFrame:
    """_key, label: the smallest text within two links of each linked text, the same for all texts
    around a common one.  Equal labels mean connected; the reverse need not hold."""
    both = found.union(found.select("b", "a")).toDF("u", "v")
    rows = 2 * found.count()
    one = in_few(both.groupBy("u").agg(F.min("v").alias("low")), rows).select(F.col("u").alias("v"), F.least("u", "low").alias("low"))
    two = in_few(both.join(one, "v"), rows).groupBy("u").agg(F.min("low").alias("low"))
    return in_few(two, rows).select(F.col("u").alias("_key"), F.col("low").alias("label"))


def _still_apart(members: DataFrame, lead: DataFrame, found: DataFrame, rows: int) -> DataFrame:
    """Members (of ``rows``) of buckets whose label differs from those of this round's leaders, where two or
    more labels are left."""
    labels = broadcast_if_small(stage(_labels(found), "minhash-labels"))
    relabel = lambda df, key, old: df.join(labels.select(F.col("_key").alias(key), F.col("label").alias("_new")), key, "left") \
        .withColumn(old, F.coalesce("_new", old)).drop("_new")
    lead = in_few(relabel(lead, "leader", "lead_label").select("band", F.col("lead_label").alias("label")).distinct(), rows)
    rest = in_few(relabel(members, "_key", "label").join(lead, ["band", "label"], "left_anti"), rows)
    return _open_buckets(rest.select("_key", "band", "mates", "label", "light"), rows)


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for the nodes of ``edges`` (a, b).

    Alternates two steps until nothing changes: larger neighbours of a node move to its smallest
    neighbour, then smaller ones do.  Each is a partially aggregated minimum and a join."""
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v")
    edges = stage(in_few(edges.distinct(), edges.count()), "cc-edges")
    while True:
        rows = 2 * edges.count()  # a step makes no more edges than both ways of its input
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = in_few(both.groupBy("u").agg(F.min("v").alias("low")), rows).select("u", F.least("u", "low").alias("low"))
        large = in_few(both.where("v > u").join(low, "u"), rows).select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = stage(in_few(large.where("u != v").distinct(), rows), "cc-large")
        low = in_few(large.groupBy("u").agg(F.min("v").alias("low")), rows)
        small = in_few(large.join(low, "u"), rows).where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        small = stage(in_few(small.union(low.select("u", F.col("low").alias("v"))).distinct(), rows), "cc-small")
        if _same(edges, small):
            nodes = in_few(small.groupBy("u").agg(F.min("v").alias("root")), rows)
            return nodes.select(F.col("u").alias("node"), "root") \
                .union(in_few(small.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct(), rows))
        edges = small


def _same(a: DataFrame, b: DataFrame) -> bool:
    digest = [F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    return a.agg(*digest).first() == b.agg(*digest).first()


def classes(docs: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS,
            rows: int = ROWS) -> DataFrame:
    """doc_id, _h (hash of the text), class_id (smallest doc_id of the class), class_size and first
    (whether the row is the class's first by doc_id, then text hash): one row per row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stage(sign(docs, k, bands, rows), "minhash-signed")
    found = links(signed.where("doc_id is not null"), docs, k, threshold)
    group = stage(components(found), "minhash-components")
    # rows without an id come last
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("_h").alias("h"))
    rows = signed.count()
    texts = in_few(signed.groupBy("_key").agg(F.min(place).alias("low"), F.count(F.lit(1)).alias("n")), rows)
    texts = in_few(texts.join(group, texts._key == group.node, "left"), rows) \
        .select("_key", "low", "n", F.coalesce("root", "_key").alias("root"))
    texts = stage(texts, "minhash-texts")
    named = in_few(texts.groupBy("root").agg(F.min("low").alias("first"), F.sum("n").alias("class_size")), rows)
    named = stage(in_few(texts.join(named, "root"), rows).select("_key", "first", "class_size"), "minhash-named")
    return in_few(signed.join(named, "_key"), rows).select(
        "doc_id", "_h", F.col("first.i").alias("class_id"), "class_size", (place == F.col("first")).alias("first"))


def keep_first(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that come first in their class, columns unchanged.  Of rows that are
    equal in id and text one stays."""
    return shielded(docs, ("doc_id", "text"), lambda d: _keep_first(d, parameters))


def _keep_first(docs: DataFrame, parameters: dict) -> DataFrame:
    found = stage(classes(docs, **parameters), "minhash-classes")
    rows = docs.withColumn("_i", F.col("doc_id").cast("long")).withColumn("_t", F.xxhash64(F.col("text").cast("string")))
    gone = broadcast_if_small(found.where(~F.col("first")).select("doc_id", "_h").distinct().alias("gone"))
    rows = rows.join(gone, F.col("_i").eqNullSafe(F.col("gone.doc_id")) & (F.col("_t") == F.col("gone._h")), "left_anti")
    again = in_few(found.where("first").groupBy("doc_id", "_h").agg(F.count(F.lit(1)).alias("n")), found.count())
    again = stage(again.where("n > 1"), "minhash-again")
    if not again.isEmpty():
        again = broadcast_if_small(again).alias("again")
        same = F.col("_i").eqNullSafe(F.col("again.doc_id")) & (F.col("_t") == F.col("again._h"))
        rows = rows.join(again, same, "left_anti").union(rows.join(again, same, "left_semi").dropDuplicates(["_i", "_t"]))
    return rows
