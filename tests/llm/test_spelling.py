"""Spelling variants (operator 11): against all pairs of small vocabularies, and the query against its SQL."""

from __future__ import annotations

import random
import zlib

import duckdb
import pytest

from llm_cases import ODD, SF, documents
from tidemark.llm import spelling
from tidemark.llm.queries import ORACLE_SQL, QUERIES


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(vocab: dict[str, int], ratio: int = 5) -> set[tuple]:
    near = {w: [u for u in vocab if u != w and one_edit(u, w)] for w in vocab}
    form = {}
    for w, some in near.items():
        if some:
            u = min(some, key=lambda x: (-vocab[x], x))
            if vocab[u] >= ratio * vocab[w]:
                form[w] = u

    def root(w):
        while w in form:
            w = form[w]
        return w
    return {(w, n, len(near[w]), form.get(w), vocab.get(form.get(w)), root(w)) for w, n in vocab.items()}


def random_vocabulary(seed: int, letters: str, low: int, high: int, size: int) -> dict[str, int]:
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(low, high))) for _ in range(size)}
    return {w: int(5 * 3 ** (6 * rng.random())) for w in sorted(words)}


@pytest.mark.parametrize("part_words", [100_000, 7])  # whole parts, and parts cut into cells
@pytest.mark.parametrize("letters,low,high", [("abc", 1, 9), ("aÿz", 6, 10)])
def test_equals_all_pairs(spark, letters, low, high, part_words):
    vocab = random_vocabulary(low, letters, low, high, 250)
    df = spark.createDataFrame(list(vocab.items()), "word string, n long")
    got = spelling.variant_groups(df, part_words=part_words)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    rows = [tuple(r) for r in got.collect()]
    want = plain(vocab)
    assert len(rows) == len(want) and set(rows) == want
    assert low > 1 or any(r[3] and r[5] != r[3] for r in rows)  # forms of forms


def test_chunks_do_not_matter(spark, monkeypatch):
    import pyarrow as pa
    vocab = random_vocabulary(4, "abcd", 6, 9, 600)
    df = spark.createDataFrame(list(vocab.items()), "word string, n long")
    rows = spelling._parts(df, 40).sort("m", "side", "cell", "sided", "listed").toPandas()
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    pieces = [batch.slice(i, 37) for i in range(0, batch.num_rows, 37)]
    totals = []
    for codes, queries in ((1 << 20, 1 << 14), (50, 3)):
        monkeypatch.setattr(spelling, "CHUNK_CODES", codes)
        monkeypatch.setattr(spelling, "QUERIES", queries)
        total = {}
        for out in spelling._walk_partition(iter(pieces)):
            for r in out.to_pylist():
                n, best = total.get(r["word"], (0, (1, "")))
                total[r["word"]] = (n + r["n_near"], min(best, (-r["form_n"], r["form"])))
        totals.append(total)
    assert totals[0] == totals[1] and {w: t[0] for w, t in totals[0].items()} == {r[0]: r[2] for r in plain(vocab) if r[2]}


def test_ties_take_the_smallest_word(spark):
    vocab = {"kitten": 5, "bitten": 30, "mitten": 30, "kittens": 30, "zzzzzz": 9}
    got = {r.word: r for r in spelling.variant_groups(spark.createDataFrame(list(vocab.items()), "word string, n long")).collect()}
    assert got["kitten"].form == got["kitten"].root == "bitten" and got["kitten"].n_near == 3
    assert got["bitten"].form is None and got["bitten"].root == "bitten" and got["zzzzzz"].n_near == 0


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    res = con.execute(ORACLE_SQL["op11_spelling_variants"])
    cols = [d[0] for d in res.description]
    want = {tuple(sorted(zip(cols, r))) for r in res.fetchall()}
    df = QUERIES["op11_spelling_variants"](spark, SF)
    got = {tuple(sorted(r.asDict().items())) for r in df.collect()}
    assert got == want and len(want) > 200


def test_occurrences_and_planted_misspellings(spark):
    rows = [*ODD, (30, "ÀÉÎ abÀcdÿf'tenant TENANT_x", "a", "fr")]
    df = spelling.word_occurrences(documents(spark, rows, extra=True), 6)
    assert sorted(r.word for r in df.where("doc_id = 30").collect()) == ["abÀcdÿf", "tenant", "tenant"]
    assert df.where("doc_id IN (1, 2, 6, 7, 8)").isEmpty()
    some = [(i, "spelling") for i in range(1500)] + [(None, "variants")]
    got = spelling.with_planted_misspellings(spark.createDataFrame(some, "doc_id long, word string")).collect()
    for r in got:
        word = "variants" if r.doc_id is None else "spelling"
        h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{word}".encode())
        k = h % len(word)
        assert r.word == (word[:k] + word[k + 1:] if h % 199 == 0 else word)
    assert {r.word for r in got} - {"spelling", "variants"}


def test_empty_and_long_words(spark):
    empty = spark.createDataFrame([], "word string, n long")
    assert spelling.variant_groups(empty).count() == 0
    long_ = "x" * 3000
    vocab = {long_: 50, long_ + "y": 6, "y" + long_: 60, long_[:-1] + "z": 5}
    got = {r.word: r for r in spelling.variant_groups(spark.createDataFrame(list(vocab.items()), "word string, n long")).collect()}
    assert got[long_].n_near == 3 and got[long_ + "y"].form == long_ and got[long_[:-1] + "z"].root == long_
