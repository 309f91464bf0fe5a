"""The registered queries of this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (crf_quality, decontaminate, html_extract, isolation, langid, mixing,
                          moore_lewis, periodic_runs, pii, prob_minhash, spelling, tokens, warc)
from tidemark.llm.common import crc_mod, new_path, stage, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, digested from the files."""
    import public_tokenizers

    path = tokens.encode_to_shared(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                   public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return tokens.token_digests(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op2_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes from each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.pareto_mix(docs, weights=(3, 1, 2), share=1.5, max_copies=2) \
        .select("doc_id", "size", "source_size", "target", "taken")


@query
def op4_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = crf_quality.fit(docs, table(spark, sf_dir, "labels"))
    return model.score(docs, keep=["doc_id"]).select(
        "doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in benchmark windows."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                        table(spark, sf_dir, "benchmark"), n=13, share=20)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


ORACLE_SQL["op5_decontaminate"] = r"""
WITH lowered AS (
  SELECT 'd' AS kind, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), words AS (
  SELECT kind, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered
), windows AS (
  SELECT id AS item_id, least(len(w), 13) AS n, w[s : s + least(len(w), 13) - 1] AS gram
  FROM words, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(s)
  WHERE kind = 'b' AND len(w) > 0
), grams AS (
  SELECT id AS doc_id, s, l.n, w[s : s + l.n - 1] AS gram
  FROM words, (SELECT DISTINCT n FROM windows) AS l, unnest(range(1, len(w) - l.n + 2)) AS u(s)
  WHERE kind = 'd' AND len(w) >= l.n
), found AS (
  SELECT DISTINCT g.doc_id, g.s, g.n, v.item_id FROM grams g JOIN windows v ON g.n = v.n AND g.gram = v.gram
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, unnest(range(s, s + n)) AS u(p) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id
)
SELECT d.id AS doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM words d LEFT JOIN hit h ON d.id = h.doc_id LEFT JOIN items i ON d.id = i.doc_id
WHERE d.kind = 'd'
"""


@query
def op8_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    found = prob_minhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"), k=5, threshold=0.8)
    return found.select("doc_id", "class_id", "class_size")


@query
def op6_isolation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = isolation.fit(docs, table(spark, sf_dir, "labels"))
    return model.judge(docs).select("doc_id", *isolation.BASE, "base_failed", "kept", "anomaly")


@query
def op7_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.main_text(table(spark, sf_dir, "pages"))


@query
def op10_centroid_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, folds=4, held_out=2)
    return model.predict(docs).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"),
                                      "lang_pred", "score", "rejected")


@query
def op9_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss difference of every document; the target domain is the documents labelled good."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return moore_lewis.cross_entropy_difference(table(spark, sf_dir, "documents").select("doc_id", "text"), good)


@query
def op3_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = stage(pii.find(docs), "pii-found")
    terms = stage(pii.disclosing_terms(docs, found), "pii-disclosing")
    every = pii.spans(docs, found, terms)
    return every.select(
        "doc_id", *[pii.count_kind("base", k).alias(f"n_{k}") for k in pii.KINDS[:4]],
        F.sha2(pii.digest("base"), 256).alias("base_sha256"), pii.digest("spans").alias("spans"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, some of which have repetition written into them first."""
    docs = periodic_runs.with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.runs(docs, min_length=6, min_exponent=4).withColumn("top", periodic_runs.top_run("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
                        F.expr("(1000 * top.length) div top.period").alias("exponent_milli"),
                        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, form and root."""
    words = spelling.with_planted_misspellings(spelling.word_occurrences(table(spark, sf_dir, "documents"), min_length=6))
    vocab = stage(spelling.vocabulary(words, min_length=6, min_count=5), "spelling-vocabulary")
    return spelling.variant_groups(vocab, ratio=5).select("word", "form", "root", "n", "n_near", "form_n")


# crc32 byte by byte from its table, near words by equal texts after one deletion
ORACLE_SQL["op11_spelling_variants"] = r"""
WITH RECURSIVE step AS (
  SELECT range AS i, 0 AS k, range::BIGINT AS c FROM range(256)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8
), tab AS (
  SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8
), low AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), runs AS (
  SELECT id || ':' || w AS s, w, count(*) AS k
  FROM (SELECT id, unnest(regexp_extract_all(t, '[a-z\x{00C0}-\x{00FF}]+')) AS w FROM low) WHERE length(w) >= 6 GROUP BY ALL
), hashed AS (
  SELECT w, k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(s)), lambda i: ('0x' || hex(encode(s))[2 * i + 1 : 2 * i + 2])::BIGINT)),
                               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM runs, tab
), words AS (
  SELECT word, sum(k)::BIGINT AS n
  FROM (SELECT k, CASE WHEN h % 199 = 0 THEN w[1 : h % length(w)] || w[h % length(w) + 2 :] ELSE w END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5
), cut AS (
  SELECT word, n, i, word[1 : i - 1] || word[i + 1 :] AS short FROM words, unnest(range(1, length(word) + 1)) AS u(i)
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.short = b.short AND a.word <> b.word
  UNION
  SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.short = b.word
  UNION
  SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.short = b.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form,
         CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), path AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL
  SELECT p.word, f.word, f.form FROM path p JOIN forms f ON f.word = p.next
)
SELECT f.word, f.form, p.root, f.n, f.n_near, f.form_n FROM forms f JOIN path p ON p.word = f.word AND p.next IS NULL
"""


@query
def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WARC archives of all pages, read back."""
    path = new_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path, min_revisit=100)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL["op12_warc"] = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS payload_bytes, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
  FROM pages
)
SELECT page_id, payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM payloads
"""
