"""The training-corpus pipeline over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``.  All but the last
return the columns of ``docs``, whatever they are.

1. toxicity        rejected documents go
2. exact_dedup     of equal texts one row stays
3. ngram_jaccard   of each component of near copies the smallest id stays
4. pii             spans of personal data are masked, ``n_chars`` follows
5. packing         token pieces packed into sequences of 2048

Rows without an id are never near copies; they take part in everything else.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import best_fit, exact_dedup, ngram_jaccard, pii, toxicity
from factloom.llm.common import free_name, let, staged

CAPACITY = 2048


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(os.path.join(sf_dir, "labels.parquet"))
    model = toxicity.train(docs, labels)
    column = free_name(docs, "__toxicity")
    scored = toxicity.score(docs, model, score_col=column, keep_text=True)
    return scored.filter(F.col(column) < toxicity.THRESHOLD).select(*_names(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies are op1's: sets of 4-word shingles at Jaccard 0.85, not the five
    words and 0.8 of the general rule, so pairs that only reach 0.8 both stay."""
    found = ngram_jaccard.join(docs, 4, 85)
    gone = staged(found.filter("component_id <> doc_id").select("doc_id").distinct(), "near-copies")
    return docs.join(gone, "doc_id", "left_anti").select(*_names(docs))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text = let(pii.find_spans(F.col("text")), lambda spans: pii.masked(F.col("text"), spans))
    changed = docs.withColumn("text", text)
    return changed.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else changed


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = best_fit.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), CAPACITY)
    return best_fit.pack(cut, CAPACITY)


def _names(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_jaccard", drop_near_copies),
          ("pii", mask_personal_data), ("packing", pack)]
#: The first stage trains a model, which SQL cannot express; the tests hold the
#: stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
