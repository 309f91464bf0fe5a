import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from llm_cases import ODD, SF, documents as frame
from pyspark.sql import functions as F
from tidemark.llm import langid, moore_lewis, queries


def test_counts_of_grams():
    assert langid.counts("ab").sum() == 2 + 3 + 2 and langid.counts("!! 12") is None and langid.counts(None) is None
    assert (langid.counts("Ab, cd") == langid.counts("ab...cd")).all()


def test_clusters_find_separate_directions():
    x = np.zeros((40, langid.DIMS), dtype=np.float32)
    x[:20, 1], x[20:, 2] = 1, 1
    c = langid.cluster(x, 2)
    assert sorted(c.argmax(axis=1)) == [1, 2]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op10_centroid_langid(spark, sf).toPandas()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id]).all()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas()
    m = rows[rows.held_out].merge(docs, on="doc_id")
    assert (m.lang_pred == m.lang).mean() > 0.97 and m.score.between(0, 1).all()


def test_language_of_odd_rows(spark):
    docs = frame(spark, ODD, extra=True)
    model = langid.fit(docs, folds=1, held_out=-1, clusters=2)
    rows = model.predict(docs).collect()
    assert len(rows) == len(ODD)
    assert all(r.lang_pred == "und" and r.score == 0 and r.rejected for r in rows if r.doc_id in (1, 2, 6, 7))
    assert {r.lang_pred for r in rows if r.doc_id == 9} == {"ja"}
    assert model.predict(frame(spark, [])).count() == 0
    nothing = langid.fit(docs.where("false")).predict(docs).collect()
    assert {r.lang_pred for r in nothing} == {"und"} and len(nothing) == len(ODD)


def test_a_rare_language_is_learned_beside_a_hot_one(spark):
    rows = [(i, f"the words of text number {i} are as common as the others", "a", "en") for i in range(400)]
    rows += [(1000 + i, f"сколько слов есть в этом редком тексте {'аб'[i % 2]}", "a", "ru") for i in range(4)]
    model = langid.fit(frame(spark, rows), folds=1, held_out=-1, max_docs=10, clusters=2)
    assert set(model.languages) == {"en", "ru"}
    got = {r.doc_id: r.lang_pred for r in model.predict(frame(spark, rows)).collect()}
    assert got == {i: lang for i, _, _, lang in rows}


def test_far_texts_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    far = frame(spark, [(1, "zqx jkvw qqz xkj wvq zzk jqx " * 20, "a", None)])
    assert model.predict(far).first().rejected
    assert model.predict(docs).agg(F.avg(F.col("rejected").cast("int"))).first()[0] < 0.05


def brute_losses(docs, i):
    """Losses of text ``i`` under models of all other texts, from plain dictionaries."""
    words = [re.findall(r"\w+", t.lower()) for t, _ in docs]
    size = [sum(len(w) for w, (_, g) in zip(words, docs) if g == k) for k in (True, False)]
    out = []
    for kind, total in zip((True, False), size):
        scale = min(size) / max(total, 1)
        one, two, ctx = Counter(), Counter(), Counter()
        for j, (w, (_, g)) in enumerate(zip(words, docs)):
            if g == kind and j != i:
                one.update(w)
                two.update(zip([None, *w], w))
                ctx.update([None, *w][:len(w)])
        loss = 0.0
        for a, b in zip([None, *words[i]], words[i]):
            base = (scale * one[b] + 1) / (scale * sum(one.values()) + moore_lewis.VOCABULARY)
            loss -= math.log((scale * two[a, b] + moore_lewis.BACKING * base) / (scale * ctx[a] + moore_lewis.BACKING))
        out.append(loss / len(words[i]))
    return out


def test_losses_against_dictionaries(spark):
    docs = [("the cat sat on the mat the cat", True), ("a cat on a mat", True), ("stock prices fell on the day", False),
            ("the stock fell", False), ("prices fell and fell and the cat", False)]
    df = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(docs)], "doc_id long, text string, good boolean")
    for r in moore_lewis.cross_entropy_difference(df, F.col("good")).collect():
        want = brute_losses(docs, r.doc_id)
        assert [r.loss_target, r.loss_background] == pytest.approx(want, rel=1e-4)
        assert r.score == pytest.approx(want[0] - want[1], abs=1e-4)


def test_every_pair_has_a_count_of_its_own(spark, monkeypatch):
    """More different pairs than a table of fixed size could part, over many blocks, against dictionaries."""
    monkeypatch.setattr(moore_lewis, "BLOCK_BYTES", 1 << 19)
    rng = np.random.default_rng(7)
    docs = [(" ".join(f"w{x}" for x in rng.integers(0, 3000 * (1 + i % 3), 1500)), i % 3 == 0) for i in range(900)]
    one, two, ctx = ([Counter(), Counter()] for _ in range(3))
    words = [t.split() for t, _ in docs]
    for w, (_, g) in zip(words, docs):
        one[g].update(w), two[g].update(zip([None, *w], w)), ctx[g].update([None, *w][:-1])
    assert len(two[0]) + len(two[1]) > 1_000_000
    size = [sum(c.values()) for c in one]
    df = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(docs)], "doc_id long, text string, good boolean")
    rows = {r.doc_id: r for r in moore_lewis.cross_entropy_difference(df, F.col("good")).collect()}
    for i in range(0, 900, 97):
        w, want = words[i], []
        for g in (True, False):
            own = (Counter(w), Counter(zip([None, *w], w)), Counter([None, *w][:-1])) if docs[i][1] == g else (Counter(),) * 3
            scale, loss = min(size) / size[g], 0.0
            for a, b in zip([None, *w], w):
                base = (scale * (one[g][b] - own[0][b]) + 1) / (scale * (size[g] - own[0].total()) + moore_lewis.VOCABULARY)
                loss -= math.log((scale * (two[g][a, b] - own[1][a, b]) + moore_lewis.BACKING * base)
                                 / (scale * (ctx[g][a] - own[2][a]) + moore_lewis.BACKING))
            want.append(loss / len(w))
        assert [rows[i].loss_target, rows[i].loss_background] == pytest.approx(want, rel=1e-9)
    tokens = moore_lewis.token_losses(df.select("doc_id", "text", F.col("good").alias("is_target"))).where("doc_id = 97").first()
    assert tokens.words == words[97] and np.mean(tokens.losses) == pytest.approx(rows[97].score)


def test_a_block_takes_few_bytes_a_word():
    """At its peak; 98 when arrays were wider and temporary ones stayed."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 500) % 100_000) for _ in range(800)]
    batch = pa.record_batch({"text": texts, "is_target": [i % 3 == 0 for i in range(800)]})
    tracemalloc.start()
    try:
        block = moore_lewis.Block([batch])
        block.order(16)
        assert tracemalloc.get_traced_memory()[1] < 75 * len(block.word) and len(block.word) == 400_000
    finally:
        tracemalloc.stop()


def test_lists_go_back_in_pieces_and_none_is_lost(monkeypatch):
    monkeypatch.setattr(moore_lewis, "PIECE", 4)
    for sizes in ([0, 3, 3, 0, 9, 1, 0], [0, 0], [], [1], [12]):
        ends = np.append(0, np.cumsum(sizes)).astype(np.int64)
        rows = pa.record_batch({"id": np.arange(len(sizes)), "x": moore_lewis._lists(np.arange(ends[-1]), ends)})
        pieces = list(moore_lewis._pieces(rows, ends))
        assert pa.Table.from_batches(pieces, rows.schema).to_pylist() == rows.to_pylist()
        assert all(len(p.column("x").flatten()) < 4 + max(sizes) for p in pieces)


def test_good_documents_score_lower(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op9_cross_entropy(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id") \
        .groupBy("quality").agg(F.avg("score").alias("m")).collect()
    m = {r.quality: r.m for r in rows}
    assert m[1] < m[0]


def test_language_model_on_odd_rows(spark):
    docs = frame(spark, ODD, extra=True)
    rows = moore_lewis.cross_entropy_difference(docs, spark.createDataFrame([(4,), (None,)], "doc_id long")).collect()
    assert len(rows) == len(ODD)
    assert all(r.n_words == 0 and r.loss_target is None and r.score == 0 for r in rows if r.doc_id in (1, 2, 6, 7))
    one_sided = moore_lewis.cross_entropy_difference(docs, F.lit(None).cast("boolean")).collect()
    assert len(one_sided) == len(ODD)
    assert moore_lewis.cross_entropy_difference(frame(spark, []), F.lit(True)).count() == 0


def test_the_sample_is_bounded_without_ids(spark):
    rows = [(None, f"text number {i}", "a", "en") for i in range(3000)] + [(7, f"other text {i}", "a", "fr") for i in range(500)]
    rows += [(i, "one text", "a", "de") for i in range(5)] + [(1, "one text", "a", "de")] * 2000 + [(None, None, "a", "it")] * 50
    got = langid.sample(frame(spark, rows).select("doc_id", "lang", "text"), 10).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in got} == {"en": 10, "fr": 10, "de": 5, "it": 1}
