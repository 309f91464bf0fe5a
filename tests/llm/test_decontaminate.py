import re

import duckdb

from llm_cases import ODD, SF, documents as frame
from tidemark.llm import decontaminate as D
from tidemark.llm import queries


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, n):
    w, hit, found = words(text), set(), set()
    for item_id, t in items:
        v = words(t)
        size = min(n, len(v))
        windows = {tuple(v[i:i + size]) for i in range(len(v) - size + 1)} if v else set()
        for i in range(len(w) - size + 1):
            if v and tuple(w[i:i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(str(item_id))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


def check(spark, rows, items, n):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.text or "", r.n_words, r.n_hit, tuple(r["items"]), r.contaminated)
                  for r in D.contamination(frame(spark, rows), bench, n).collect()), key=repr)
    want = []
    for i, t, *_ in rows:
        a, b, c, d = brute(t, items, n)
        want.append((i, t or "", a, b, tuple(c), d))
    assert got == sorted(want, key=repr)


def test_against_brute_force(spark):
    item = "The quick brown fox jumps over the lazy dog and runs away again"
    rows = [(1, "x " + item + " y", "a", "en"), (2, item.upper(), "a", "en"), (3, item.replace("fox", "cat"), "a", "en"),
            (4, "fox jumps over the lazy dog and then some more words follow here", "a", "en"),
            (5, ("the " * 30) + "quick brown", "a", "en"), (5, "b a b a b a", "a", "en"), (7, "ÉTÉ été Été", "a", "fr")] + ODD
    items = [(10, item), (9, "b a b"), (11, None), (12, ""), (13, "ÉTÉ"), (14, "word5"), (10, "dog and runs away"), (15, "the the the the the the")]
    for n in (3, 5, 13):
        check(spark, rows, items, n)


def test_oracle(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.op5_decontaminate(spark, SF)
    got = sorted(tuple(r) for r in df.collect())
    assert got == sorted(con.execute(queries.ORACLE_SQL["op5_decontaminate"]).fetchall())
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


def test_proximity(spark):
    docs = frame(spark, [(1, "alpha x beta", "a", "en"), (2, "alpha beta", "a", "en"), (3, "alpha x x x x beta", "a", "en")])
    items = D.benchmark_items(spark.createDataFrame([(1, "alpha beta")], "item_id long, text string"), 13)
    counts = D.word_counts(docs)
    pairs = D.anchors(items, counts)
    index = D.build_index(docs, pairs.selectExpr("term1 AS term").union(pairs.selectExpr("term2")).distinct(), counts)
    assert sorted((r._id, abs(r.gap)) for r in D.proximity_matches(index, pairs, 1).collect()) == [(1, 1), (2, 0)]
    assert sorted(r._id for r in D.alignments(index, pairs).collect()) == [2]


def test_empty_tables_and_other_columns(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert D.contamination(frame(spark, []), bench).count() == 0
    rows = D.contamination(frame(spark, ODD, extra=True), bench.limit(0))
    assert rows.count() == len(ODD) and rows.where("contaminated").count() == 0
    assert "_h" in rows.columns and rows.columns.count("n_words") == 1
