"""Browse screen of the profile table (P18): listed columns, facet counts and
id search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the browse screen.
LIST_COLUMNS = ["subject_id", "stay_id", "hadm_id", "anchor_age", "gender", "first_careunit"]
FACETS = ["gender", "first_careunit"]
SEARCH_FIELDS = ["subject_id", "stay_id", "hadm_id"]
#: Characters of a gram of the search index.
GRAM = 3


def browse_rows(profile: DataFrame, facet_filters: dict[str, str] | None = None) -> DataFrame:
    """Listed columns, narrowed by facet equalities (``{"gender": "F"}``)."""
    df = profile
    for col, val in (facet_filters or {}).items():
        df = df.filter(F.col(col) == val)
    return df.select(*LIST_COLUMNS)


def facet_counts(profile: DataFrame, facets: list[str] = FACETS) -> DataFrame:
    """(facet, value, n) for every facet in one pass: each row is expanded to one
    (facet, value) pair per facet, then a single grouped count (partial
    aggregation keeps hot values cheap)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value"))
                                for f in facets]))
    return (profile.select(pairs.alias("p")).select("p.facet", "p.value")
            .groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n")))


def _has_term(term: str, fields: list[str]) -> Column:
    any_field = F.lit(False)
    for f in fields:
        any_field = any_field | F.col(f).cast("string").contains(term)
    return any_field


def id_grams(profile: DataFrame, fields: list[str] = SEARCH_FIELDS) -> DataFrame:
    """The search index of the id fields: (gram, field, the three ids) for every distinct ``GRAM`` characters in a row
    of an id's text.  Stored sorted by gram, a gram's list is a few row groups."""
    text = F.col("id.text")
    starts = F.sequence(F.lit(1), F.length(text) - GRAM + 1)
    grams = F.when(F.length(text) >= GRAM, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(GRAM)))))
    ids = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields]))
    return profile.select(*SEARCH_FIELDS, ids.alias("id")).select(F.explode(grams).alias("gram"), "id.field", *SEARCH_FIELDS)


def id_search_indexed(profile: DataFrame, grams: DataFrame, query: str, fields: list[str] = SEARCH_FIELDS) -> DataFrame:
    """``id_search`` by the index: rows with every term in the text of at least one id field.

    Of a term of ``GRAM`` or more characters, the lists of its grams are intersected per field and the few rows left are
    verified on the text.  Shorter terms, which no gram holds whole, are tested on the rows that the long ones
    leave, or in a scan if there are none.  Rows without one of the ids are found by the others."""
    out = profile
    for term in query.split():
        if len(term) >= GRAM:
            wanted = sorted({term[i:i + GRAM] for i in range(len(term) - GRAM + 1)})
            lists = grams.where(F.col("gram").isin(*wanted) & F.col("field").isin(*fields))
            every = lists.groupBy(*SEARCH_FIELDS, "field").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(wanted))
            same = [F.col(f"p.{f}").eqNullSafe(F.col(f"g.{f}")) for f in SEARCH_FIELDS]
            out = out.alias("p").join(every.alias("g"), same, "left_semi")
        out = out.where(_has_term(term, fields))
    return out


def id_search(profile: DataFrame, query: str, fields: list[str] = SEARCH_FIELDS) -> DataFrame:
    """Rows where every whitespace-separated term occurs in the text of at least
    one id field (terms ANDed, fields ORed)."""
    cond = F.lit(True)
    for term in query.split():
        cond = cond & _has_term(term, fields)
    return profile.filter(cond)
