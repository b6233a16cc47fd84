"""Training corpus pipeline: quality rules, language ID, near-dedup, mixing, byte-level BPE.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of documents,
the last one the ids' digests instead. `run` writes each stage's result to the shared folder and reads it again, so a
lost executor repeats one stage at most; tables of earlier stages go as soon as the next result is written.

Nulls, ties and repeated rows are treated as the operators say: a null text fails the quality rules; a null lang is not
learned from; a null source is a source of its own; a row without doc_id is a document of its own in every stage; of
rows that share a doc_id near-dedup keeps one. Columns beyond those of documents are dropped; an empty table passes.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, langid, mixing, near_dup, quality
from graphloom.llm.common import materialize, table, worker_path
from graphloom.plans.staging import mark, release

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least mean position probability of the language a document is taken to be in.
LEAST_LANGUAGE_SCORE = 0.35


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes failing lines; drops documents that fail the base rules or lose too much text."""
    return quality.clean(docs.select(*COLUMNS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is undetermined; labelled rows are learned from."""
    worker_path(spark)
    return langid.keep_identified(docs.select(*COLUMNS), F.col("lang").isNotNull(), LEAST_LANGUAGE_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates (five words, similarity 0.8)."""
    worker_path(spark)
    return near_dup.deduplicate(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents so that sources meet their targets, in training order."""
    return mixing.training_order(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, digested, and the digest of what they decode to."""
    worker_path(spark)
    return bpe.round_trip(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: A recurrent network and hash-drawn passes have no SQL form; tests/llm compares every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        release(spark, since, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
