import pytest

from llm_cases import ODD, SF, documents as frame
from pyspark.sql import functions as F
from tidemark.llm import mixing


def filled(weights, caps, budget):
    """Water filling by rounds."""
    out, open_ = [0.0] * len(caps), set(range(len(caps)))
    left = budget
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total >= caps[i] - 1e-9}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = caps[i]
        left -= sum(caps[i] for i in over)
        open_ -= over
    return out


@pytest.mark.parametrize("caps,budget", [([10, 200, 30, 4], 100), ([5, 5, 5, 5], 20), ([1, 1, 1, 100], 50), ([8, 8, 0, 8], 3)])
def test_water_fill(spark, caps, budget):
    weights = [3.0, 1.0, 2.0, 3.0]
    rows = [(0, i, w, float(c), float(budget)) for i, (w, c) in enumerate(zip(weights, caps))]
    df = spark.createDataFrame(rows, "g int, i int, w double, c double, b double")
    got = [r.t for r in mixing.water_fill(df, "w", "c", "b", ["g"], ["i"], "t").orderBy("i").collect()]
    assert got == pytest.approx(filled(weights, caps, budget))


def test_targets_and_words_taken(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.pareto_mix(docs).toPandas()
    size = rows.text.str.count(r"[^\x20\x09-\x0D]+")
    assert (rows["size"] == size).all()
    by = rows.assign(size=size).groupby("source").agg(words=("size", "sum"), source_size=("source_size", "first"),
                                                      target=("target", "first"), taken=("taken", "sum"), largest=("size", "max"))
    assert (by.words == by.source_size).all()
    names = sorted(by.index, key=lambda s: s.encode("utf-8"))
    want = filled([(3, 1, 2)[i % 3] for i in range(len(names))], [2 * by.words[s] for s in names], 1.5 * by.words.sum())
    assert by.target[names].tolist() == pytest.approx(want)
    assert ((by.taken - by.target).abs() <= by.largest / 2 + 1).all()
    assert (rows.taken <= 2 * rows["size"]).all() and (rows.taken == rows.copies * rows["size"]).all()


def test_reruns_and_partitions_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a = mixing.pareto_mix(docs).select("doc_id", "taken").orderBy("doc_id").collect()
    b = mixing.pareto_mix(docs.repartition(7)).select("doc_id", "taken").orderBy("doc_id").collect()
    assert a == b


def test_inclusion_follows_the_probabilities(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "b").otherwise("a").alias("source"),
                                    F.concat_ws(" ", F.array_repeat(F.lit("w"), (F.col("id") % 7 + 1).cast("int"))).alias("text"))
    rows = mixing.pareto_mix(docs, weights=(1, 5), share=0.8).groupBy("source").agg(
        F.sum("taken").alias("t"), F.first("target").alias("g"), F.first("source_size").alias("s"), F.max("copies").alias("c"))
    for r in rows.collect():
        assert abs(r.t - r.g) <= 7 and r.c <= 2


def test_longer_documents_are_likelier(spark):
    rows = [(i, " ".join(["w"] * (64 if i % 2 else 2)), "a", "en") for i in range(2000)]
    got = mixing.pareto_mix(frame(spark, rows), share=0.5, tier_preference=0.5).groupBy("size").agg(F.avg("copies").alias("m"))
    m = {r["size"]: r.m for r in got.collect()}
    assert m[64] > m[2]


def test_odd_rows(spark):
    df = mixing.pareto_mix(frame(spark, ODD, extra=True))
    rows = df.collect()
    assert len(rows) == len(ODD)
    assert all(r["size"] == 0 and r.taken == 0 for r in rows if not (r.text or "").strip(" \t\n"))
    assert {r.source for r in rows} == {"a", "b", "c", None}
    assert "_h" in df.columns and "Taken" not in df.columns and "taken" in df.columns


def test_empty_table(spark):
    assert mixing.pareto_mix(frame(spark, [])).collect() == []
