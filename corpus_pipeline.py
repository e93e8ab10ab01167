"""The training-corpus pipeline: toxic documents go, repeated line chunks are
cut out, one document of each near-duplicate group stays, copies of test items
go, and what is left is packed into training windows.

Every stage reads what its predecessor wrote as Parquet.  All but the last
return the columns of ``documents``; ``n_chars`` follows the text.

Nulls, empty and very long texts, ties, repeated rows, empty tables and further
columns with clashing names have the results that the docstrings of the stages'
operators state; texts are passed on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiclust.llm import decontaminate, line_chunks, packing, simhash, toxicity
from lexiclust.llm.common import written
from lexiclust.llm.queries import tokenizer_path
from lexiclust.session import load


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the subsequence-kernel machine scores under one half."""
    return toxicity.clean(docs, load(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the multi-line chunks and the passages of over 50 words
    that occur before; none is dropped."""
    cut = line_chunks.deduplicate(docs, passage_words=line_chunks.PASSAGE_WORDS)
    length = F.when(F.col("_chunk_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", length).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of SimHash links."""
    return simhash.deduplicate(docs)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a test item."""
    return decontaminate.clean(docs, load(spark, sf_dir, "benchmark"))


def into_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in windows of 2048 tokens."""
    return packing.pack(docs, tokenizer_path(), keep_ids=False)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("simhash_dedup", without_near_duplicates),
    ("decontamination", without_test_items),
    ("packing", into_windows),
]

#: neither the kernel machine nor the alignment has a SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents`` below ``sf_dir``."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
