"""From raw documents to packed sequences: filter, deduplicate, cut repeats, pack.

Each stage takes what its predecessor kept, written as Parquet in between; all
but the last return the columns of documents.
"""

from __future__ import annotations

import functools
import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from apportion.llm import near_duplicates, packing, quality, queries, suffix_arrays  # noqa: E402
from apportion.session import written  # noqa: E402


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model finds too unlike trusted text go."""
    return quality.keep_good(docs, queries.table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    queries.carry(spark)
    return near_duplicates.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings as long as a passage of some fifty words that occur more than once are cut out."""
    queries.carry(spark)
    return suffix_arrays.cut_texts(docs, suffix_arrays.PASSAGES)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences."""
    queries.carry(spark)
    return packing.pack(docs, functools.partial(packing.tokenizer_encoder, queries.VOCABULARY))


STAGES = [
    ("quality", judge),
    ("near_duplicates", deduplicate),
    ("suffix_arrays", cut_repeats),
    ("packing", pack),
]

# The language model and the tokenizer are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
