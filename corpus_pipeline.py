"""Five-stage cleaning of a document corpus, each stage one operator of kbloom.llm.

Stages take (spark, docs, sf_dir) and return the documents they keep, with the
columns of ``documents``; the last returns each document's token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbloom.llm import bpe, decontaminate, near_copies, quality_rules, substring_dedup
from kbloom.llm._io import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list reject.

    Null and empty texts fail the base rules; repeated rows are judged each.
    """
    return quality_rules.keep_good(spark, docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near-copies (5-word shingles, Jaccard 0.8).

    SimHash finds the nearest copies and prefix filtering the rest.  Texts without
    a word are copies of each other; rows without a doc_id stay.
    """
    return near_copies.keep_first(spark, docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a document with a smaller id has.

    Documents that lose all their words stay with an empty text.
    """
    return _measured(substring_dedup.remove_duplicates(spark, docs))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; null and empty texts stay as they are."""
    return _measured(decontaminate.remove_benchmark(spark, docs, table(spark, sf_dir, "benchmark")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and how many; none for a null or empty text."""
    out = bpe.encode_documents(spark, docs.select("doc_id", "lang", "source", "text"))
    return out.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


STAGES = [
    ("quality_rules", quality),
    ("simhash_dedup", near_duplicates),
    ("substring_dedup", substrings),
    ("decontaminate", benchmark),
    ("bpe", tokens),
]

#: SQL expresses neither the learned rules nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
