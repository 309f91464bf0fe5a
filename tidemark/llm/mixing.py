"""Mixing sources to target weights by Pareto order sampling.

1. Every document has a size in words.  Sources get a share of a word budget by weight; a
   share stops at ``max_copies`` times its source's words and the excess goes to the others
   by weight (``water_fill``).
2. Inside a source, documents belong to length tiers (whole powers of two).  A tier's
   preference raises the expected number of copies of its documents; the same
   ``water_fill`` turns preferences into expected copies per tier, so that they add up to
   the source's target and none is above ``max_copies``.
3. The whole part of the expected copies is taken for certain.  The fraction is an inclusion
   probability ``p``: with ``u`` a uniform number drawn from the document's key and a seed,
   documents are ranked by ``(u / (1 - u)) / (p / (1 - p))`` and taken in that order as long as
   the source's remaining words hold them.  The size that is fixed is the words taken: the gap
   that is left is closed by the one document behind the cut whose size is nearest to it.

The ranking never sorts a source in one task.  Ranks are cut into bins twice; sums per bin
tell which bin holds the boundary, and only rows of that last bin are ordered.

All of it is DataFrame functions.  Null or empty texts have size 0 and are never taken; a
null source is a source of its own (last); an empty table gives an empty result; equal ranks
are ordered by id and text hash, and rows equal in both are taken alike.  Extra columns pass
through; columns named like the results are replaced.  Results depend only on the rows and the seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast_if_small, shielded, stage

WORD = r"[^\x20\x09-\x0D]+"
BINS = 4096
RESULTS = ("size", "source_size", "target", "copies", "taken")


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(groups: DataFrame, weight: str, cap: str, budget: str, by: list[str], order: list[str],
               out: str) -> DataFrame:
    """Adds ``out``: ``budget`` shared by ``weight`` among the rows of each ``by``, none above
    its ``cap``.

    With rows in order of cap / weight, the rows that stop at their cap are a prefix: row k
    stops if it would do so when all before it stopped.  The rest share what is left by weight."""
    total, key = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_ratio", *order)
    before = key.rowsBetween(Window.unboundedPreceding, -1)
    g = groups.withColumn("_ratio", F.col(cap) / F.col(weight))
    g = g.withColumn("_left", F.col(budget) - F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
    g = g.withColumn("_rest", F.sum(weight).over(total) - F.coalesce(F.sum(weight).over(before), F.lit(0.0)))
    g = g.withColumn("_stops", F.col(cap) * F.col("_rest") <= F.col(weight) * F.col("_left"))
    # the level at the first row that does not stop holds for it and all after it
    g = g.withColumn("_level", F.first(F.when(~F.col("_stops"), F.greatest(F.col("_left"), F.lit(0.0)) / F.col("_rest")),
                                       ignorenulls=True).over(key.rowsBetween(Window.unboundedPreceding, 0)))
    return g.withColumn(out, F.when(F.col("_level").isNull(), F.col(cap))
                        .otherwise(F.least(F.col(cap), F.col(weight) * F.col("_level")))) \
        .drop("_ratio", "_left", "_rest", "_stops", "_level")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_copies: float) -> DataFrame:
    """source, source_size, target: ``weights`` repeat over the sources by code point, null last."""
    g = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source: these windows run over the list of sources, not over documents
    everything = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    g = g.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), rank % len(weights) + 1))
    g = g.withColumn("_cap", F.col("source_size") * F.lit(float(max_copies)))
    g = g.withColumn("_budget", F.sum("source_size").over(everything) * F.lit(float(share))).withColumn("_all", F.lit(0))
    g = water_fill(g, "_w", "_cap", "_budget", ["_all"], ["source"], "target")
    return g.select("source", "source_size", "target")


def pareto_mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5,
               max_copies: int = 2, seed: int = 17, tier_preference: float = 0.05) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, source, more) with size, source_size, target (its
    source's), copies and taken (= copies x size).

    ``tier_preference``: expected copies grow by this part with each doubling of the length."""
    return shielded(docs, ("doc_id", "text", "source"),
                    lambda d: _mix(d, weights, share, max_copies, seed, tier_preference), RESULTS)


def _mix(docs: DataFrame, weights, share, max_copies, seed, tier_preference) -> DataFrame:
    rows = _sized(docs, seed)
    keyed = stage(rows.select("doc_id", "source", "size", "_h", "_tier", "_u"), "mix-sizes")
    tiers, sources = _plan(keyed, weights, share, max_copies, tier_preference)
    rows = _ranked(rows, tiers)
    b = broadcast_if_small(sources).alias("b")
    a = rows.alias("a")
    rows = a.join(b, a.source.eqNullSafe(b.source), "left")
    place = F.struct(F.col("a._q").alias("q"), F.col("a.doc_id").alias("i"), F.col("a._h").alias("h"))
    picked = F.col("a._q").isNotNull() & ((place <= F.col("b._cut")) | place.eqNullSafe(F.col("b._closing")))
    copies = (F.col("a._sure") + F.when(picked, 1).otherwise(0)).cast("int")
    return rows.select("a.*", "b.source_size", "b.target", copies.alias("copies")) \
        .withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    rows = docs.withColumn("size", word_count("text")).withColumn("_h", F.xxhash64("text"))
    rows = rows.withColumn("_tier", F.floor(F.log2(F.greatest(F.col("size"), F.lit(1)))).cast("int"))
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "_h", F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return rows.withColumn("_u", u)


def _ranked(rows: DataFrame, tiers: DataFrame) -> DataFrame:
    """Adds _sure (certain copies) and _q: random odds over inclusion odds, mapped to 0..1
    without changing the order; null where nothing is left to chance."""
    b = broadcast_if_small(tiers.select("source", "_tier", "_sure", "_p")).alias("b")
    a = rows.alias("a")
    rows = a.join(b, a.source.eqNullSafe(b.source) & (F.col("a._tier") == F.col("b._tier")), "left") \
        .select("a.*", F.coalesce("b._sure", F.lit(0)).alias("_sure"), F.coalesce("b._p", F.lit(0.0)).alias("_p"))
    odds, chance = F.col("_u") / (1 - F.col("_u")), F.col("_p") / (1 - F.col("_p"))
    q = odds / (odds + chance)
    return rows.withColumn("_q", F.when((F.col("_p") > 0) & (F.col("size") > 0), q)).drop("_p")


def _plan(keyed: DataFrame, weights, share, max_copies, tier_preference) -> tuple[DataFrame, DataFrame]:
    """Per source and tier the certain copies and the inclusion probability; per source its
    size, its target and the last place of the ranking that is taken."""
    targets = stage(source_targets(keyed, weights, share, max_copies), "mix-targets")
    t = targets.alias("t")
    tiers = keyed.where("size > 0").groupBy("source", "_tier").agg(F.sum("size").alias("_words")).alias("g")
    tiers = tiers.join(t, tiers.source.eqNullSafe(t.source)).select("g.*", "t.target")
    tiers = tiers.withColumn("_w", F.col("_words") * (1.0 + F.lit(tier_preference) * F.col("_tier")))
    tiers = tiers.withColumn("_cap", F.col("_words") * F.lit(float(max_copies)))
    tiers = water_fill(tiers, "_w", "_cap", "target", ["source"], ["_tier"], "_part")
    expected = F.round(F.col("_part") / F.col("_words"), 12)
    tiers = stage(tiers.select("source", "_tier", "_words", F.floor(expected).alias("_sure"),
                               (expected - F.floor(expected)).alias("_p")), "mix-tiers")

    g = tiers.groupBy("source").agg(F.sum(F.col("_sure") * F.col("_words")).alias("_certain")).alias("g")
    left = t.join(g, t.source.eqNullSafe(g.source), "left").select(
        "t.*", (F.col("t.target") - F.coalesce(F.col("g._certain"), F.lit(0))).alias("_left"))

    # bins of the rank, fine ones inside coarse ones; powers of two keep the cuts exact
    rows = _ranked(keyed, tiers).where("_q is not null")
    rows = rows.withColumn("_b1", F.floor(F.col("_q") * BINS)) \
        .withColumn("_b2", F.floor(F.col("_q") * BINS * BINS) - F.col("_b1") * BINS)
    edge1 = stage(_edge(rows, "_b1", left), "mix-edge1")
    inside = rows.alias("a").join(broadcast_if_small(edge1).alias("e"),
                                  F.col("a.source").eqNullSafe(F.col("e.source")) & (F.col("a._b1") == F.col("e._b")))
    inside = stage(inside.select("a.source", "a.size", "a._q", "a.doc_id", "a._h", "a._b1", "a._b2"), "mix-inside")
    edge2 = stage(_edge(inside, "_b2", edge1), "mix-edge2")
    last = inside.alias("a").join(edge2.alias("e"), F.col("a.source").eqNullSafe(F.col("e.source"))
                                  & (F.col("a._b2") == F.col("e._b"))).select("a.*", "e._left")
    w = Window.partitionBy("source").orderBy("_q", "doc_id", "_h").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("_ahead", F.coalesce(F.sum("size").over(w), F.lit(0)))
    fits = F.col("_left") - F.col("_ahead") >= F.col("size")
    place = F.struct(F.col("_q").alias("q"), F.col("doc_id").alias("i"), F.col("_h").alias("h"))
    last = last.groupBy("source").agg(
        F.max(F.when(fits, place)).alias("_taken"),
        (F.first("_left") - F.coalesce(F.max(F.when(fits, F.col("_ahead") + F.col("size"))), F.lit(0))).alias("_gap"),
        F.first((F.col("_b1") * BINS + F.col("_b2")) / (BINS * BINS)).alias("_from"))
    none = F.lit(None).cast("long")
    before = F.struct(F.col("c._from").alias("q"), none.alias("i"), none.alias("h"))
    everything = F.struct(F.lit(2.0).alias("q"), none.alias("i"), none.alias("h"))
    c = last.alias("c")
    cut = F.when(F.col("l._left") <= 0, F.struct(F.lit(-1.0).alias("q"), none.alias("i"), none.alias("h"))) \
        .when(F.col("c._taken").isNotNull(), F.col("c._taken")).when(F.col("c._from").isNotNull(), before) \
        .otherwise(everything)
    sources = left.alias("l").join(c, F.col("l.source").eqNullSafe(F.col("c.source")), "left") \
        .select("l.source", "l.source_size", "l.target", cut.alias("_cut"),
                F.when(F.col("l._left") > 0, F.col("c._gap")).alias("_gap"))
    sources = stage(sources, "mix-sources")

    behind = rows.alias("r").join(broadcast_if_small(sources).alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
    place = F.struct(F.col("r._q").alias("q"), F.col("r.doc_id").alias("i"), F.col("r._h").alias("h"))
    off = F.abs(F.col("r.size") - F.col("s._gap"))
    behind = behind.where((place > F.col("s._cut")) & (off < F.col("s._gap")))
    closing = behind.groupBy("r.source").agg(F.min(F.struct(off.alias("off"), place.alias("place"))).alias("_x")).alias("b")
    sources = sources.alias("s").join(closing, F.col("s.source").eqNullSafe(F.col("b.source")), "left") \
        .select("s.source", "s.source_size", "s.target", "s._cut", F.col("b._x.place").alias("_closing"))
    return tiers, stage(sources, "mix-sources")


def _edge(rows: DataFrame, bin_: str, left: DataFrame) -> DataFrame:
    """Per source, the first bin with which the sizes reach what is left to take (_b), and what
    is left before it (_left)."""
    sums = rows.groupBy("source", bin_).agg(F.sum("size").alias("_n"))
    w = Window.partitionBy("source").orderBy(bin_).rowsBetween(Window.unboundedPreceding, 0)
    s = sums.withColumn("_cum", F.sum("_n").over(w)).alias("s")
    over = s.join(left.alias("l"), F.col("s.source").eqNullSafe(F.col("l.source"))).where("s._cum >= l._left")
    first = F.min(F.struct(F.col(f"s.{bin_}").alias("b"), (F.col("l._left") - F.col("s._cum") + F.col("s._n")).alias("l")))
    return over.groupBy("s.source").agg(first.alias("_x")).select(
        "source", F.col("_x.b").alias("_b"), F.col("_x.l").alias("_left"))
