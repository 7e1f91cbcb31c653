"""The operators applied to their whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import (alignment, best_fit, byte_bpe, exact_dedup, lexical, license_scan, line_dedup, ngram_jaccard,
                          nn_descent, pii, quality, toxicity, vantage)
from factloom.llm.catalog import ORACLE, QUERIES, query  # noqa: F401
from factloom.sources.tables import table


@query("op2_byte_bpe")
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document by the multilingual byte-level ranks."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return byte_bpe.digests(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)


@query("op6_line_dedup", """
WITH l AS (SELECT doc_id, i, lines[i] AS line,
    translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
gone AS (SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone.key IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE gone.key IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN gone USING (key) GROUP BY doc_id
""")
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at least 1 character found in at least 10 documents go everywhere."""
    kept = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents", "doc_id", "text"), 10, 1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


@query("op9_pii")
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every whole text."""
    return pii.scan(table(spark, sf_dir, "documents", "doc_id", "text")).drop("found")


@query("op10_exact_dedup", r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
WINDOW w AS (PARTITION BY norm)
""")
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the smallest doc_id stays."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, tokenised and packed into sequences of 2048 tokens."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    cut = best_fit.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)
    return best_fit.pack(cut, 2048)


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, learnt from the labels not held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query("op8_vantage_point", """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
r AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score FROM v q, v c
  WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id, score FROM r QUALIFY rank <= 20
""")
def op8_vantage_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose id is divisible by 20, exact search."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return vantage.search(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20, relax=1.0)


@query("op1_ngram_jaccard")
def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles reach Jaccard 0.85."""
    return ngram_jaccard.join(table(spark, sf_dir, "documents", "doc_id", "text"), 4, 85)


@query("op3_license_scan")
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License texts in every document, with matched coverage and span."""
    return license_scan.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, shrunk toward its host and path."""
    return quality.score(table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang"),
                         table(spark, sf_dir, "labels", "doc_id", "quality"))


@query("op13_lexical_search", r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, t, len(t) AS n FROM (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents) WHERE len(t) > 0),
i AS (SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
c AS (SELECT count(*) AS big_n, sum(n) AS big_l FROM d),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d)
  WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
s AS (SELECT item_id, r,
    CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM p JOIN d USING (r) JOIN w USING (term) JOIN i USING (term), c GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
  doc_id, score FROM s JOIN d USING (r) WHERE score > 0 QUALIFY rank <= 20
""")
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents of the highest score for every item of ``benchmark``."""
    return lexical.search(table(spark, sf_dir, "documents", "doc_id", "text"),
                          table(spark, sf_dir, "benchmark", "item_id", "text"))


@query("op12_tokenizer_alignment")
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a byte-level and a piece tokenizer linked in every document, and
    what the whole corpus says of the linked id pairs."""
    return alignment.align(table(spark, sf_dir, "documents", "doc_id", "text"),
                           public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op11_embedding_near_dedup", """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b
  WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a) USING (vec_id)
""")
def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.95 among all rows of ``embeddings``, and their components."""
    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), 0.95)
