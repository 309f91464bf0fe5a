import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_cases import ODD, documents as frame
from tidemark.llm import crf_quality, isolation, queries

SF = "/root/testdata/sf0.01"


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(1)
    per_text = np.array([3, 1, 0, 4])
    emit, trans = rng.normal(size=8), rng.normal(size=(2, 2))
    alpha, beta, z = crf_quality.forward_backward(emit, trans, per_text)
    p = np.exp(alpha[:, 1] + beta[:, 1] - z)
    at = 0
    for n in per_text:
        e, mass, good = emit[at:at + n], 0.0, np.zeros(n)
        for labels in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(e[i] for i in range(n) if labels[i]) + sum(trans[labels[i], labels[i + 1]] for i in range(n - 1)))
            mass, good = mass + w, good + w * np.array(labels)
        assert p[at:at + n] == pytest.approx(good / mass)
        at += n


def test_gradient_reaches_separable_labels():
    texts = ["clean words of a line\nand one more line"] * 20 + ["*** $$$ ###\n%%% &&& ***"] * 20
    x, _, n = crf_quality.line_stats(texts)
    model = crf_quality.fit_crf(x, n, np.array([1] * 20 + [0] * 20))
    assert model.scores(texts)[0] > 0.9 and model.scores(texts)[-1] < 0.1


def test_neighbours_stay_in_their_text():
    x, _, n = crf_quality.line_stats(["a b\nc d e", "f"])
    f = crf_quality.neighbour_features(x, n)
    k = x.shape[1]
    assert (f[0, 1 + k:1 + 2 * k] == 0).all() and (f[1, 1 + k:1 + 2 * k] == x[0]).all()
    assert (f[1, 1 + 2 * k:] == 0).all() and (f[2, 1 + k:] == 0).all()


def test_crf_on_held_out_documents(spark):
    rows = queries.op4_crf_quality(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()
    assert (rows.predicted == (rows.score >= 0.3)).all() and rows.score.between(0, 1).all()
    m = rows[rows.held_out].merge(labels, on="doc_id")
    assert (m.predicted == m.quality).mean() > 0.95
    assert (m[m.quality == 1].predicted == 1).mean() > 0.98


def test_crf_odd_rows(spark):
    docs = frame(spark, ODD, extra=True)
    labels = spark.createDataFrame([(4, 1), (6, 0), (8, 1), (1, 0), (None, 1), (9, None)], "doc_id long, quality int")
    model = crf_quality.fit(docs, labels, folds=1, held_out=-1)
    rows = model.score(docs).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.score == 0 for r in rows if not (r.text or "").split())
    assert model.keep_good(docs, 0.0).columns == docs.columns
    assert model.score(frame(spark, [])).count() == 0
    nothing = crf_quality.fit(docs, labels.limit(0))
    assert {r.score for r in nothing.score(docs).collect()} == {0.0, 0.5}


def brute_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    places = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i:i + 3]), []).append(i)
    hit = {j for v in places.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            duplicates += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), duplicates, len(hit)


def test_rule_statistics(spark):
    rows = {r.doc_id: r for r in queries.op6_isolation_rules(spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        r = rows[d.doc_id]
        want = brute_stats(d.text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    passed = [(rows[i].kept, q) for i, q in labels.items() if not rows[i].base_failed]
    assert np.mean([k for k, q in passed if q == 1]) > 0.99 and np.mean([k for k, q in passed if q == 0]) < 0.1


@pytest.mark.parametrize("text", ["", "a b c a b c", "x\x1cy\x85z w", "a\n\na\n \n a\na", "a a a a a", "#*$%&|<>"])
def test_rule_statistics_of_odd_texts(text):
    assert isolation.rule_stats(text)[:5] == brute_stats(text)


def test_forest_scores_outliers_higher():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(500, 3)), [[9.0, 9.0, 9.0]]])
    s = isolation.grow_forest(x, trees=100, sample=64).scores(x)
    assert s[-1] > np.quantile(s[:-1], 0.99) and 0 < s.min() <= s.max() < 1


def test_path_length_by_recursion():
    assert float(isolation.average_path(2)) == 1 and float(isolation.average_path(1)) == 0
    assert float(isolation.average_path(256)) == pytest.approx(10.24, abs=0.1)


def test_calibration():
    scores, good = np.array([.1, .2, .3, .6, .7, .8]), np.array([True, True, True, False, True, False])
    assert .3 < isolation.calibrate(scores, good, 0.7) < .6
    assert isolation.calibrate(scores, np.ones(6, dtype=bool), 0.9) == 1.0


def test_rules_on_odd_rows(spark):
    docs = frame(spark, ODD, extra=True)
    labels = spark.createDataFrame([(3, 1), (6, 0), (None, 1)], "doc_id long, quality int")
    model = isolation.fit(docs, labels)
    rows = model.judge(docs).collect()
    assert len(rows) == len(ODD) and all(r.n_words == 0 and r.base_failed for r in rows if r.doc_id == 1)
    assert model.judge(frame(spark, [])).count() == 0
    bare = isolation.fit(docs, labels.limit(0)).judge(docs).collect()
    assert all(r.kept != r.base_failed for r in bare)


def test_repeated_labelled_rows_are_one(spark):
    rows = [(i, " ".join(f"{'good words of text' if i % 2 else '### $$$ ###'} {j}" for j in range(60 + i)), "a", "en") for i in range(1, 40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, quality int")
    once, often = frame(spark, rows), frame(spark, rows + [rows[4]] * 300 + [rows[7]] * 50)
    a, b = (crf_quality.fit(d, labels, folds=1, held_out=-1) for d in (once, often))
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.transitions, b.transitions)
    a, b = (isolation.fit(d, labels) for d in (once, often))
    assert a.threshold == b.threshold and np.array_equal(a.forest.value, b.forest.value)


def test_long_texts_are_learned_from_by_their_first_lines(spark):
    line = {0: "### $$$ %%%", 1: "the words of a good line"}
    rows = [(i, "\n".join([line[i % 2]] * (30 if i % 3 else 3000)), "a", "en") for i in range(1, 30)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 30)], "doc_id long, quality int")
    cut = [(i, "\n".join(t.split("\n")[:100]), s, lang) for i, t, s, lang in rows]
    a, b = (crf_quality.fit(frame(spark, r), labels, max_lines=100, folds=1, held_out=-1) for r in (rows, cut))
    assert not np.array_equal(a.weights, np.zeros_like(a.weights)) and a.weights.shape == b.weights.shape


def test_forest_and_threshold_come_from_every_labelled_row(spark):
    """More labelled rows than any bounded sample held: only the last ids by hash are bad, and they are found."""
    n = 9000
    bad = {r.id for r in spark.range(n).orderBy(F.xxhash64("id").desc()).limit(40).collect()}
    is_bad = F.col("id").isin(*bad)
    noise, plain = " ".join(f"###{i}" for i in range(80)), " ".join(f"word{i}" for i in range(80))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(is_bad, noise).otherwise(plain).alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.when(is_bad, 0).otherwise(1).alias("quality"))
    assert isolation.labelled_stats(docs, labels).count() == n
    rows = isolation.fit(docs, labels).judge(docs).collect()
    assert {r.doc_id for r in rows if not r.kept} == bad and not any(r.base_failed for r in rows)


def test_draw_is_by_smallest_hash(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"))
    want = {r.doc_id for r in rows.orderBy(F.xxhash64("doc_id")).limit(100).collect()}
    assert {r.doc_id for r in isolation._draw(rows, 100)} == want and len(isolation._draw(rows, 5000)) == 3000


def test_threshold_over_a_table_is_that_of_arrays(spark):
    rng = np.random.default_rng(5)
    for scores, good in ((rng.random(700).round(2), rng.random(700) < .8), (np.array([.5, .5]), np.array([True, False])),
                         (np.array([.1, .9]), np.array([True, True]))):
        df = spark.createDataFrame(list(zip(scores.tolist(), good.tolist())), "anomaly double, good boolean")
        for share in (.5, .995):
            assert isolation.calibrate_all(df.repartition(7), share) == isolation.calibrate(scores, good, share)
