"""A training corpus from documents: language ID, near duplicates, repeated passages, decontamination, packing.

Every stage but the last returns the columns of documents, whatever others there are and however they are named.
A row with a null doc_id takes no part in comparisons between documents and stays; null, empty and letterless
texts go in the first stage. ``n_chars``, where it exists, follows a text that a stage cuts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.llm.decontamination import without_passages
from lorespan.llm.language import fit_if_labelled, in_known_languages
from lorespan.llm.parity_join import Similarity, one_of_each_group
from lorespan.llm.queries import BYTE_BPE, PACKING
from lorespan.llm.store import settle
from lorespan.llm.substrings import without_repeats
from lorespan.llm.vector_packing import pack_examples


def _cut(docs: DataFrame, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``change`` applied to docs; ``n_chars`` follows the texts that it changed."""
    if "n_chars" not in docs.columns:
        return change(docs)
    was = max(docs.columns, key=len) + "_"  # a name that docs have not
    length, n_chars = F.length("text"), F.col("n_chars")
    out = change(docs.withColumn(was, length))
    return out.withColumn("n_chars", F.when(length != F.col(was), length).otherwise(n_chars).cast(docs.schema["n_chars"].dataType)).drop(was)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, learned from a bounded sample of the labelled ones; rejected ones go, all where none is labelled."""
    return in_known_languages(docs, fit_if_labelled(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at a Jaccard similarity of 0.8 on five-word shingles, the smallest doc_id."""
    return one_of_each_group(docs, Similarity(shingle=5, num=8, den=10))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-word passages that an earlier document has; documents of nothing else go."""
    return _cut(docs, without_repeats)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less than a twentieth of which is benchmark passages, without these passages."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _cut(docs, lambda rows: without_passages(rows, benchmark))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of at most 1,024 tokens."""
    return pack_examples(docs, BYTE_BPE, **PACKING)


STAGES = [
    ("language ID", language_id),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Similarity components, exact windows over all texts and token ids are not SQL's; tests/llm hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
