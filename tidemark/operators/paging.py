"""Pages of an ordered list without a global sort, an eager count, or a top-k of all rows before the page.

Three passes in one plan, each over the columns it needs:

1. quantiles of the key (a mergeable sketch) cut the list into ``BINS`` ranges;
2. exact counts per range, at most ``BINS`` rows, give each range's first rank and the total;
   the requested page, held to the pages there are, becomes a span of ranks;
3. the rows of the one or two ranges that meet the span are ranked inside their range, and the
   span is kept.

So a deep page costs what the first one does: one range in a task, never ``page`` x ``size`` rows.
Quantiles only shape the ranges; ranks and the total are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of the list; a task sorts one in so many parts of it.
BINS = 64


def page_number(requested) -> int | None:
    """The requested page as a number; what is not an integer asks for page 1."""
    try:
        return int(requested)
    except (TypeError, ValueError):
        return 1


def with_range(df: DataFrame, key: str, bins: int = BINS) -> DataFrame:
    """``df`` with the ``range`` of each row's key, from 0: the number of quantiles below it."""
    cuts = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    bounds = df.agg(F.percentile_approx(key, cuts, 10_000).alias("bounds")).scalar()
    return df.withColumn("_bounds", bounds).withColumn("range", F.size(F.filter("_bounds", lambda b: b < F.col(key)))).drop("_bounds")


def range_spans(ranged: DataFrame) -> DataFrame:
    """(range, start, n, total) of each range: the rank of its first row, its rows, and all rows."""
    counts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over at most BINS rows
    return counts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("start"), "n",
                         F.sum("n").over(Window.partitionBy()).alias("total"))


def key_page(df: DataFrame, key: str, requested, size: int, bins: int = BINS) -> DataFrame:
    """The rows of one page of ``df`` ordered by ``key`` (distinct values), with ``page``, ``num_pages`` and ``total``.

    A page out of range is the last one.  An empty list has an empty page."""
    ranged = with_range(df, key, bins)
    spans = range_spans(ranged)
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("int")
    asked = F.lit(page_number(requested)).cast("long")
    page = F.when(asked.between(1, pages), asked.cast("int")).otherwise(pages)
    first = (page.cast("long") - 1) * size
    # at most ``size`` ranges meet a page
    meets = (F.col("start") < first + size) & (F.col("start") + F.col("n") > first)
    wanted = spans.where(meets).select("range", "start", first.alias("_first"), page.alias("page"), pages.alias("num_pages"), "total")
    rows = ranged.join(F.broadcast(wanted), "range")
    rank = F.row_number().over(Window.partitionBy("range").orderBy(key)) - 1 + F.col("start")
    rows = rows.withColumn("_rank", rank).where((F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + size))
    return rows.select(*df.columns, "page", "num_pages", "total")
