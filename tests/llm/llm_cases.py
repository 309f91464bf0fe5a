"""Rows that several tests use."""

from __future__ import annotations

SF = "/root/testdata/sf0.001"


def documents(spark, rows, extra=False):
    """(doc_id, text, source, lang) rows; with ``extra``, columns that operators use themselves as well."""
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    if extra:
        for c in ("size", "score", "n_words", "items", "_h", "_id", "band", "copies", "Taken", "c0", "x1_", "base", "label"):
            df = df.selectExpr("*", f"doc_id AS `{c}`")
    return df


LONG = " ".join(f"word{i % 977} of" for i in range(30_000))
#: Nulls in every column, empty and very long texts, repeated rows, ids with several texts.
ODD = [
    (1, None, "a", "en"), (2, "", "a", None), (3, LONG, None, "en"), (4, "one two three four five six seven", "b", "en"),
    (4, "one two three four five six seven", "b", "en"), (4, "another text under the same id here", "b", "en"),
    (None, "a row without an id but with words", "a", "en"), (None, None, None, None), (6, "!!! ???", "a", "en"),
    (7, " \n\t \n", "a", "en"), (8, "x", "c", "en"), (9, "日本語 のテキスト \U0001f600 fin", "c", "ja"),
    (10, "one two three four five six seven", "b", "en"),
]
