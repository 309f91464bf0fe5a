"""Benchmark decontamination with a positional inverted index.

A window is ``n`` consecutive words of a benchmark item (an item of fewer words, but not
none, is one window).  A document is searched without comparing it to every window:

1. The words of all documents are counted.
2. In every window the two rarest words are picked.  Their places in the item are anchors; a
   window can occur only where both of its anchors do, at their distance.
3. The index stores a posting (term, document, position) for every occurrence of an anchor's
   term in the corpus.
4. The posting lists of the two anchors, shifted by their places in the item, are
   intersected: equal (document, start) pairs are candidate alignments.
5. Alignments are checked word by word; windows that match whole are phrase matches, and their
   words are hit.  ``proximity_matches`` reads the same index for words near each other.

All of it is DataFrame functions.  A document is known by (doc_id, hash of its text), so rows
that repeat an id stay apart and equal rows share their result.  Null texts have no words.
Repeated benchmark rows count once per item_id; empty benchmarks leave every document clean.
Extra columns pass through; result columns of the input are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast_if_small, shielded, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word with its letters as they stand; ``lowered`` lowers A-Z and nothing else.  The same
#: characters as ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]``, which Java matches many times slower.
RAW_WORD = r"[\p{Alnum}\x{80}-\x{10FFFF}]+"
RESULTS = ("n_words", "n_hit", "items", "contaminated")


def lowered(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def raw_words(text: str) -> Column:
    return F.regexp_extract_all(F.col(text), F.lit(RAW_WORD), F.lit(0))


def keyed(docs: DataFrame) -> DataFrame:
    """Adds the key of a document: its id (null: -1) and a hash of id and text."""
    return docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))) \
        .withColumn("_h", F.xxhash64("doc_id", "text"))


def benchmark_items(benchmark: DataFrame, n: int) -> DataFrame:
    """item (a number for each item text), item_id, words, size and length of its windows."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"),
                            raw_words_lowered("text").alias("words")).where(F.size("words") > 0).distinct()
    return rows.withColumn("item", F.xxhash64("item_id", "words")).withColumn("size", F.size("words")) \
        .withColumn("length", F.least(F.col("size"), F.lit(n)))


def raw_words_lowered(text: str) -> Column:
    return F.regexp_extract_all(lowered(F.col(text)), F.lit(RAW_WORD), F.lit(0))


def word_counts(docs: DataFrame) -> DataFrame:
    """raw, n: every word form of the corpus with its number of occurrences."""
    return docs.select(F.explode(raw_words("text")).alias("raw")).groupBy("raw").agg(F.count(F.lit(1)).alias("n"))


def anchors(items: DataFrame, counts: DataFrame) -> DataFrame:
    """item, term1, place1, term2, place2: for each window its rarest word and the next rarest one.

    A window of one word, or with a word that the corpus lacks, pairs that word with itself."""
    places = items.select("item", "length", "size", F.posexplode("words").alias("place", "term"))
    terms = places.select("term").distinct()
    known = counts.select(lowered(F.col("raw")).alias("term"), "n").join(terms, "term", "left_semi") \
        .groupBy("term").agg(F.sum("n").alias("n"))
    places = places.join(known, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # each place belongs to the windows that start at most length - 1 words before it
    starts = F.sequence(F.greatest(F.col("place") - F.col("length") + 1, F.lit(0)),
                        F.least(F.col("place"), F.col("size") - F.col("length")))
    rows = places.withColumn("start", F.explode(starts))
    rank = F.row_number().over(Window.partitionBy("item", "start").orderBy("n", "place"))
    rows = rows.withColumn("rank", rank).where("rank <= 2")
    pick = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    pairs = rows.groupBy("item", "start").agg(
        pick(1, "term").alias("term1"), pick(1, "place").alias("place1"), pick(1, "n").alias("n1"),
        pick(2, "term").alias("term2"), pick(2, "place").alias("place2"))
    return pairs.where("n1 > 0").select(
        "item", "term1", "place1", F.coalesce("term2", "term1").alias("term2"),
        F.coalesce("place2", "place1").alias("place2")).distinct()


def build_index(docs: DataFrame, terms: DataFrame, counts: DataFrame) -> DataFrame:
    """The postings (term, _id, _h, position) of ``terms`` over the whole corpus.

    Words are matched by the forms that the corpus holds, so texts need no lowering."""
    forms = counts.select("raw", lowered(F.col("raw")).alias("term")).join(terms.select("term"), "term", "left_semi")
    forms = stage(forms, "index-forms")
    words = keyed(docs).select("_id", "_h", F.posexplode(raw_words("text")).alias("position", "raw"))
    return words.join(broadcast_if_small(forms), "raw").select("term", "_id", "_h", "position")


def alignments(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """_id, _h, item, shift: where the shifted posting lists of both anchors of a window meet."""
    first = index.join(broadcast_if_small(pairs), index.term == pairs.term1) \
        .select("_id", "_h", "item", (F.col("position") - F.col("place1")).alias("shift"), "term2", "place2")
    second = index.select("_id", "_h", F.col("term").alias("term2"), F.col("position").alias("at"))
    first = first.withColumn("at", F.col("shift") + F.col("place2"))
    return first.join(second, ["_id", "_h", "term2", "at"], "left_semi").select("_id", "_h", "item", "shift").distinct()


def phrase_matches(docs: DataFrame, found: DataFrame, items: DataFrame) -> DataFrame:
    """_id, _h, item, start, length: windows of items that occur whole in documents, with the
    place of their first word in the document."""
    wanted = stage(found.select("_id", "_h").distinct(), "decon-wanted")
    texts = keyed(docs.select("doc_id", "text")).join(broadcast_if_small(wanted), ["_id", "_h"], "left_semi") \
        .select("_id", "_h", "text").distinct()
    texts = texts.select("_id", "_h", raw_words_lowered("text").alias("have"))
    rows = found.join(texts, ["_id", "_h"]).join(broadcast_if_small(items.select("item", "words", "size", "length")), "item")
    # words of the document beside the item's; places outside the document stay null
    lead = F.greatest(-F.col("shift"), F.lit(0))
    have = F.concat(F.array_repeat(F.lit(None).cast("string"), lead),
                    F.slice("have", F.greatest(F.col("shift"), F.lit(0)) + 1, F.col("size") - F.least(lead, F.col("size"))))
    same = F.zip_with("words", have, lambda a, b: F.when(a == b, F.lit("1")).otherwise(F.lit("0")))
    rows = rows.withColumn("_same", F.array_join(F.slice(same, F.lit(1), F.col("size")), ""))
    starts = F.filter(F.sequence(F.lit(0), F.col("size") - F.col("length")),
                      lambda s: F.substring(F.col("_same"), s + 1, F.col("length")) == F.repeat(F.lit("1"), F.col("length")))
    starts = F.transform(starts, lambda s: s + F.col("shift"))
    return rows.select("_id", "_h", "item", "length", F.explode(starts).alias("start"))


def proximity_matches(index: DataFrame, pairs: DataFrame, within: int) -> DataFrame:
    """_id, _h, item, shift, gap: where both anchors of a window occur with a distance that differs
    from the item's by at most ``within`` words (gap: the difference).

    Positions are cut into cells of ``within`` + 1 words; a pair of places can only meet in its
    own or a neighbouring cell, so the join stays an equality join."""
    cell = within + 1
    first = index.join(broadcast_if_small(pairs), index.term == pairs.term1) \
        .select("_id", "_h", "item", (F.col("position") - F.col("place1")).alias("shift"), "term2", "place2")
    first = first.withColumn("at", F.col("shift") + F.col("place2"))
    near = F.array(*[F.floor(F.col("at") / cell) + F.lit(k) for k in (-1, 0, 1)])
    first = first.withColumn("cell", F.explode(near))
    second = index.select("_id", "_h", F.col("term").alias("term2"), F.col("position").alias("other"),
                          F.floor(F.col("position") / cell).alias("cell"))
    rows = first.join(second, ["_id", "_h", "term2", "cell"])
    gap = F.col("other") - F.col("at")
    return rows.where(F.abs(gap) <= within).select("_id", "_h", "item", "shift", gap.alias("gap")).distinct()


def search(docs: DataFrame, benchmark: DataFrame, n: int = 13) -> DataFrame:
    """Phrase matches of every window of ``benchmark`` in ``docs``, with item_id."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    items = stage(benchmark_items(benchmark, n), "decon-items")
    counts = stage(word_counts(docs), "decon-counts")
    pairs = stage(anchors(items, counts), "decon-anchors")
    terms = pairs.select(F.col("term1").alias("term")).union(pairs.select("term2")).distinct()
    index = stage(build_index(docs, terms, counts), "decon-index")
    found = stage(alignments(index, pairs), "decon-alignments")
    return phrase_matches(docs, found, items).join(broadcast_if_small(items.select("item", "item_id")), "item")


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20) -> DataFrame:
    """``docs`` with n_words, n_hit, items (ids with occurring windows, sorted as strings) and
    contaminated (n_hit > 0 and share * n_hit >= n_words)."""
    return shielded(docs, ("doc_id", "text"), lambda d: _contamination(d, benchmark, n, share), RESULTS)


def _contamination(docs: DataFrame, benchmark: DataFrame, n: int, share: int) -> DataFrame:
    matches = stage(search(docs, benchmark, n), "decon-matches")
    places = matches.select("_id", "_h", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("at"))
    hit = places.distinct().groupBy("_id", "_h").agg(F.count(F.lit(1)).alias("n_hit"))
    # as long as the benchmark at most
    which = matches.select("_id", "_h", "item_id").distinct().groupBy("_id", "_h") \
        .agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    result = stage(hit.join(which, ["_id", "_h"]), "decon-hits")
    rows = keyed(docs).withColumn("n_words", F.coalesce(F.regexp_count("text", F.lit(RAW_WORD)), F.lit(0)).cast("long"))
    rows = rows.join(broadcast_if_small(result), ["_id", "_h"], "left").drop("_id", "_h")
    rows = rows.withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long")) \
        .withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
