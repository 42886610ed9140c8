"""A corpus made ready for training: five stages over ``documents``.

Each stage takes what its predecessor kept, as a written table. All but the last
return rows like those of ``documents``; the last returns the pieces of packed
sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import mixing, near_dup, packing, quality, substring
from tidemark.llm.queries import TOKENIZER
from tidemark.llm.tables import stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier scores below 0.3."""
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"), training=table(spark, sf_dir, "documents"))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of every near-duplicate class."""
    return near_dup.drop_near_duplicates(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 50 words and more that an earlier document has."""
    return substring.dedup_substrings(docs, with_text=True)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes the sources in their target shares; several epochs of a document are several rows."""
    return mixing.mix_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens into sequences of 2048."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicate removal", near_dup_stage),
    ("substring dedup", substring_stage),
    ("source mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Training, ProbMinHash and BPE are not SQL; tests/llm/test_pipeline.py checks each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
