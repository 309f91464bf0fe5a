"""A bit filter of a fixed size over a set of keys, to thin out rows before an exchange.

The filter is one array of ``words`` longs, computed from the keys in the plan that uses it (a
scalar subquery) and looked up inside code generation.  Its size does not follow the data, so it
reaches every task whatever the number of keys.  A key of the set always passes; others
pass with a probability that grows with the set (two bits per key: about 2 % at 1/12 key per bit), so a
test on the filter must be followed by an exact one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2^14 longs: 128 KB.
WORDS = 1 << 14


def as_id(column: str) -> Column:
    """An integer id in the type that filters hash."""
    return F.col(column).cast("long")


def _places(columns: list[Column], words: int) -> list[tuple[Column, Column]]:
    """(index, bit) of the two bits of a key."""
    out = []
    for seed in (0, 1):
        h = F.xxhash64(*columns, F.lit(seed))
        out.append((F.pmod(h, F.lit(words)).cast("int"), F.shiftrightunsigned(h, 58).cast("int")))
    return out


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at)


def key_filter(keys: DataFrame, columns: list[Column], words: int = WORDS) -> Column:
    """The filter of the keys as a column, the same on every row.  Its keys and those that are tested must have equal
    types, as hashes differ between types (ids: ``as_id``)."""
    pairs = F.array(*[F.struct(i.alias("i"), _bit(b).alias("bit")) for i, b in _places(columns, words)])
    set_ = keys.select(F.explode(pairs).alias("p")).groupBy(F.col("p.i").cast("long").alias("id")).agg(F.bit_or("p.bit").alias("bits"))
    every = keys.sparkSession.range(words).join(set_, "id", "left")
    dense = F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return every.agg(dense["bits"].alias("bits")).scalar()


def may_hold(filter_: Column, columns: list[Column], words: int = WORDS) -> Column:
    """Whether a key may be in the set; false only if it is not."""
    test = F.lit(True)
    for i, b in _places(columns, words):
        test = test & (F.element_at(filter_, i + 1).bitwiseAND(_bit(b)) != 0)
    return test
