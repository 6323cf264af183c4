"""The corpus pipeline: quality, exact dedup, near-dedup, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept, and returns a DataFrame. All but the last return the
columns of documents; the last returns the pieces of the packed sequences.

In every stage a null text counts as empty, whole texts are read however long, columns beside the documents' own are carried along whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.llm.exact_dedup import drop_exact_copies
from tenderlake.llm.ordinal_quality import keep_good, train
from tenderlake.llm.packing import pack_documents
from tenderlake.llm.secret_scan import redact_secrets
from tenderlake.llm.similar_sets import drop_near_copies
from tenderlake.sources.tables import load_table, materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tail probability of the best grade is high enough; fitted on a bounded sample of the rated ones.

    Documents are judged by their texts alone: null and repeated ids don't matter, and equal texts stay or go together. Without a rating all stay. Null ratings and ratings of unknown ids are passed over.
    """
    return keep_good(docs, train(docs, load_table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for blanks, the longest; of equally long ones that with the smallest id, a null id last; of rows that repeat an id and a text, one. Null and empty texts are copies of each other."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity 0.8 or more, and whatever such pairs connect), the one with the smallest id. A text of fewer words is one shingle; texts without a word are copies of each other."""
    return drop_near_copies(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and ``n_chars`` counted again; a null text stays null and keeps its ``n_chars``. Ids aren't read."""
    masked = redact_secrets(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of up to 2,048 tokens, a row for each piece. A null or empty text is its closing token alone; rows that repeat an id are pieces of their own documents."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("exact dedup", exact), ("near dedup", near), ("secrets", secrets), ("packing", packing)]

#: Neither the regression nor the packing can be said in SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
