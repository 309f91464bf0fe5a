"""The training-data pipeline: quality, near duplicates, benchmark passages, mixture, token ids.

``STAGES`` lists (name, function) pairs; a function takes (spark, docs, sf_dir) and returns the
documents that it keeps, with the columns of ``documents`` (the last one: the token rows, read
from the token files).  ``run`` writes every stage's result as Parquet in the shared folder and
reads it back as the next one's input, so a lost executor never costs more than one stage.

Empty inputs are defined by the operators; the quality stage needs labels of both classes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import crf_quality, decontaminate, mixing, prob_minhash, tokens
from tidemark.llm.common import shielded, stage, table

#: A document below this score is rejected.
QUALITY = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the line model rejects."""
    return crf_quality.fit(docs, table(spark, sf_dir, "labels")).keep_good(docs, QUALITY)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class, the one with the smallest id."""
    return prob_minhash.keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents."""
    benchmark = table(spark, sf_dir, "benchmark")
    return shielded(docs, ("doc_id", "text"), lambda d: decontaminate.contamination(d, benchmark).where(~F.col("contaminated")))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that each source comes near its target words."""
    return shielded(docs, ("doc_id", "text", "source"), lambda d: mixing.pareto_mix(d).where("copies > 0")
                    .withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the documents in ascending id order, and their rows read back."""
    import public_tokenizers

    path = tokens.encode_to_shared(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return tokens.token_digests(spark, path)


STAGES = [
    ("quality classifier", quality_classifier),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("source mixing", source_mixing),
    ("token output", token_output),
]

#: A fitted model decides the first stage, so SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
