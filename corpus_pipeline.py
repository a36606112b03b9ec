"""The corpus pipeline: toxicity, exact copies, near copies, benchmark leaks, tokens.

STAGES lists (name, function). Each function takes (spark, docs, sf_dir), where
docs has the columns of documents, and returns a DataFrame; what a stage keeps
is written as Parquet and read again as the docs of the next one. All but the
last return the columns they got.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from machinepulse.llm import bpe, content_sort, decontaminate, ngram_join, registry, toxicity
from machinepulse.llm.common import (
    free_name,
    read,
    rows_kept,
    rows_leading,
    rows_without,
    scratch,
)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; the model learns from docs itself."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), train=toxicity.training_rows())
    name = free_name("score", docs.columns)
    return toxicity.score(docs, model, name=name).where(F.col(name) < 0.5).drop(name)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    groups = content_sort.content_groups(docs, keep="largest")
    kept = groups.where("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("digest"))
    return rows_kept(docs, kept)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar word shingles the one with the smallest doc_id.

    Of several texts with that doc_id one stays. Documents without words are not
    linked, so all of them stay; rows that repeat doc_id and text come once.
    """
    kept = ngram_join.leaders(docs).where("leads")
    return rows_leading(docs, kept.select(F.col("doc_id").alias("id"), "version"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    found = decontaminate.occurrences(docs, read(spark, sf_dir, "benchmark"))
    return rows_without(docs, found)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text."""
    path = public_tokenizers.path(registry.TOKENIZER)
    return registry.digests(bpe.decode(bpe.encode(docs.select("doc_id", "text"), path), path))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("encode", encode),
]

# The first stage is a trained model and the last a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
