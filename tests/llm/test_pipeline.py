import corpus_pipeline as P
from llm_cases import ODD, documents as frame
from pyspark.sql import functions as F
from tidemark.llm import mixing
from tidemark.llm.common import stage

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    seen = [docs]
    for name, step in P.STAGES[:4]:
        seen.append(stage(step(spark, seen[-1], SF), "test"))
        assert seen[-1].columns == docs.columns
    n = [d.count() for d in seen]
    assert n[0] > n[1] > n[2] > n[3]
    judged = seen[1].join(labels, "doc_id").groupBy("quality").count().collect()
    bad = {r.quality: r["count"] for r in judged}
    good = labels.where("quality = 1").count()
    assert bad.get(1, 0) >= 0.98 * good and bad.get(0, 0) <= 0.1 * labels.where("quality = 0").count()
    assert seen[2].join(seen[1], docs.columns, "left_anti").count() == 0
    mixed = seen[4].groupBy("doc_id").count().agg(F.max("count").alias("m")).first().m
    assert mixed == 2
    words = seen[4].groupBy("source").agg(F.sum(mixing.word_count("text")).alias("n")).collect()
    targets = {r.source: r.target for r in mixing.pareto_mix(seen[3]).select("source", "target").distinct().collect()}
    assert all(abs(r.n - targets[r.source]) <= 0.1 * targets[r.source] for r in words)
    out = P.token_output(spark, seen[4], SF).orderBy("start").collect()
    assert len(out) == n[4] == seen[4].count() if len(n) > 4 else len(out) == seen[4].count()
    at = 0
    for r in out:
        assert r.start == at
        at += r.n_tokens


def test_odd_rows_pass_through(spark, tmp_path):
    docs = frame(spark, ODD, extra=True)
    spark.createDataFrame([(4, 1), (6, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "nothing of this occurs")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (docs, docs.limit(0)):
        for name, step in P.STAGES[1:4]:
            rows = stage(step(spark, rows, str(tmp_path)), "test")
            assert rows.columns == docs.columns
        assert P.token_output(spark, rows, str(tmp_path)).count() == rows.count()
    assert P.quality_classifier(spark, docs, str(tmp_path)).columns == docs.columns
    assert P.quality_classifier(spark, docs.limit(0), str(tmp_path)).count() == 0
