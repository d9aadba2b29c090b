"""Corpus pipeline: quality classifier, quality rules, near-duplicates, mixing, BPE.

``STAGES`` lists (name, function of (spark, docs, sf_dir)); each stage gets what its predecessor kept, written and read
again. ``run`` applies them to ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vellumine.llm import bpe, compression, mixing, quality, similar
from vellumine.session import read_table, shared_folder


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on ``labels``, doesn't reject."""
    return quality.good_documents(docs, read_table(spark, sf_dir, "labels"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that base rules and compression bands keep."""
    return compression.kept_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near copies: candidates by SimHash, and by bands where its radius
    can't reach, of which those whose 5-word shingles have Jaccard 0.8 or more are linked."""
    return similar.first_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources as documents: whole texts per pass, then the words of blocks taken once more."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe.coded_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", classify),
    ("quality rules", apply_rules),
    ("near duplicates", drop_near_duplicates),
    ("source mix", mix),
    ("bpe", encode),
]

#: Hashes, compression and merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        folder = shared_folder(spark, f"pipeline-{number}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(folder)
        docs = spark.read.schema(out.schema).parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
