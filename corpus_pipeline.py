"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage works on all that its predecessor kept. All but the last return the columns of ``documents``; a
document that the mix takes twice has two rows from then on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fluxtone.llm import exact_dedup, language_id, mixing, ngram_join, packing
from fluxtone.llm.common import stored, table

#: Rejected are texts without a letter, and those whose best language has a lower mean probability than this.
LEAST_LANGUAGE_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs, LEAST_LANGUAGE_SCORE)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one that gives the group its name, the smallest doc_id."""
    return ngram_join.drop_near_copies(docs, k=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pieces(docs, added=True)


STAGES = [
    ("language ID", language),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

#: SQL expresses neither the network nor the tokenizer; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
