"""Runs of words (operator 13): against a plain search of every period, and the planted repetition."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_cases import ODD, SF, documents
from tidemark.llm import periodic_runs
from tidemark.llm.queries import QUERIES


def plain_runs(words, min_length=6, min_exponent=4):
    """Every stretch of every period from the smallest on; a stretch seen before had a smaller one."""
    n, out = len(words), {}
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(min_length, min_exponent * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, m, q) for (s, m), q in out.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60), st.sampled_from([(6, 4), (2, 2), (3, 3)]))
def test_equals_plain_search(letters, least):
    words = [x.encode() for x in letters]
    assert [tuple(r) for r in periodic_runs.word_runs(words, *least).tolist()] == plain_runs(words, *least)


def test_equals_plain_search_on_planted_periods():
    rng = random.Random(5)
    for _ in range(400):
        words = [rng.choice("abcdefgh").encode() for _ in range(rng.randrange(200))]
        for _ in range(rng.randrange(4)):
            a, p, m = rng.randrange(len(words) + 1), rng.randrange(1, 12), rng.randrange(60)
            for i in range(a, min(len(words), a + m)):
                words[i] = words[a + (i - a) % p]
        assert [tuple(r) for r in periodic_runs.word_runs(words).tolist()] == plain_runs(words)


def test_long_texts_of_one_period():
    for block in (["x"], ["of", "the", "end"], [f"w{i}" for i in range(5000)]):
        words = [x.encode() for x in block] * (40_000 // len(block))
        assert periodic_runs.word_runs(words).tolist() == [[0, len(words), len(block)]]


def test_extensions_of_all_pairs():
    import numpy as np
    rng = random.Random(2)
    for size in (1, 2, 40, 150):
        text = [rng.choice([1, 2]) for _ in range(size)]
        x = periodic_runs.Extensions(text)
        pairs = [(i, j) for i in range(size) for j in range(size) if i != j]
        if not pairs:
            continue
        got = x(*np.array(pairs).T)
        for (i, j), g in zip(pairs, got):
            k = 0
            while max(i, j) + k < size and text[i + k] == text[j + k]:
                k += 1
            assert g == k
        assert sorted(range(size), key=lambda i: text[i:]) == [i for i in np.argsort(x.rank) if i < size]


def expected(doc_id, text):
    """The contract's row, step by step."""
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    top = None
    for r in found:
        if top is None or r[1] * top[2] > top[1] * r[2]:
            top = r
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
            digest("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()),
            digest(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_on_all_documents(spark):
    got = {r[0]: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, SF).collect()}
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    want = {i: expected(i, t) for i, t in rows}
    assert got == want and sum(r[1] for r in want.values()) > 5


def test_odd_rows(spark):
    rows = [*ODD, (20, "a b " * 5, "a", "en"), (21, "same " * 5, "a", "en"), (22, "same " * 6, "a", "en"),
            (21, "same\t" * 7, "a", "en"), (None, "x y z " * 4 + "x", None, None)]
    df = documents(spark, rows, extra=True)
    got = periodic_runs.runs(df, keep=["doc_id", "label"]).collect()
    assert len(got) == len(rows) and all(r.label == r.doc_id for r in got)
    by = sorted(((r.doc_id or -1, [tuple(x) for x in r.runs], r.collapsed) for r in got if r.runs and r.doc_id != 3), key=repr)
    assert [tuple(x) for r in got if r.doc_id == 3 for x in r.runs] == [(0, 60_000, 2 * 977)]
    assert by == sorted([(20, [(0, 10, 2)], "a b"), (22, [(0, 6, 1)], "same"), (21, [(0, 7, 1)], "same"),
                         (-1, [(0, 13, 3)], "x y z")], key=repr)
    assert {r.n_words for r in got if r.doc_id in (1, 2, 7)} == {0}
    assert periodic_runs.runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.runs(df, min_exponent=1)
