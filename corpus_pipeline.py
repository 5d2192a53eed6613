"""From raw documents to packed training sequences, in five stages of the training-data operators.

Each stage takes what the one before kept: quality classifier, exact dedup, SimHash near-dedup, removal of
long repeated passages, best-fit packing. All but the last return the columns of ``documents``, whatever these are.
Null texts count as empty, whole texts of any length are looked at, and an empty table gives an empty one. Rows
without an id pass the near-copy stage as they are; rows that repeat an id stay or go there together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from argusframe.llm._common import stored
from argusframe.llm.exact_dedup import keep_one
from argusframe.llm.packing import pack_documents
from argusframe.llm.quality import keep_good
from argusframe.llm.simhash import keep_one_of_each_group
from argusframe.llm.suffix_dedup import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; equal texts, and so ties, stay or go together. Without labels all stay."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; rows that repeat it all stay."""
    return keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, by fingerprint or by shingles, the smallest doc_id stays."""
    return keep_one_of_each_group(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that also stand elsewhere are cut, in all places: the words of strings of 51 that also
    start elsewhere. Documents stay, if need be empty."""
    return without_repeats(docs, 51, words=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048, a row a piece; an empty text is one piece with the end id."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_copies),
    ("simhash", near_copies),
    ("suffix_array", repeated_passages),
    ("packing", packing),
]

# Classifier, fingerprint links, components and packing are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
