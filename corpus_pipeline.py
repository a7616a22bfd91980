"""The corpus pipeline: quality classifier, line dedup, near-dedup, mixing to target weights, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's ``docs``. All but the last return the columns of ``documents``.

Defined cases are those of the operators that the stages call: null, empty and blank texts, texts of any length, repeated
rows, repeated and null ids, and extra columns of any name pass through each stage without an error; null and empty
texts are judged by the classifier like any other, count no lines, are one class of near copies, weigh nothing in the
mix (a source without words gives no documents) and pack as their end mark; ties go as each operator says; empty
tables, and labels that match no document, give a defined result: without anything to learn every score is the smoothed
base rate.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import line_dedup, mixing, near_copies, packing, quality_model
from tidemark.llm.common import shared_folder, table
from tidemark.storage import removed


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the labelled ones among them, accepts."""
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; lines that stood before, alone or in runs, are gone from their texts."""
    return line_dedup.dedup_lines(docs, window=1)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: SimHash links of five-word shingles and, where these leave texts apart, min-wise
    ones; each link verified to have a Jaccard similarity of 0.8 or more."""
    return near_copies.drop_near_copies(docs, shingle=5, threshold=0.8)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of a fixed token budget."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_repeated_lines),
    ("simhash near-dedup", one_of_each),
    ("source mixing", mixed),
    ("packing", packed),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; what each one returns is written to the shared folder and removed once the
    next one is written. What the last one returns stays, as the result is read from there."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if i:
            removed(spark, f"{folder}/{i - 1}.parquet")
    return docs
