"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratacloud.llm._shared import Scratch, read_table
from stratacloud.llm.minhash_dedup import minhash_stage
from stratacloud.llm.mixing import mixing_stage
from stratacloud.llm.quality import quality_stage
from stratacloud.llm.secret_scan import secrets_stage
from stratacloud.llm.sentencepiece_lattice import sentencepiece_stage
from stratacloud.shipping import ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    ship_package(spark)
    return quality_stage(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: one document of each group stays."""
    ship_package(spark)
    return minhash_stage(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan: every secret becomes a mark."""
    ship_package(spark)
    return secrets_stage(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: documents as often as the mix takes them."""
    ship_package(spark)
    return mixing_stage(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding: piece numbers of every text, and the text that they decode to."""
    ship_package(spark)
    return sentencepiece_stage(docs)


STAGES = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_duplicates),
    ("secret_scan", secrets),
    ("source_mixing", mixing),
    ("sentencepiece", sentencepiece),
]

#: The stages learn and encode, which SQL does not express; tests/llm holds each stage against a plain version of it.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs, before = read_table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        docs = scratch.save(out, name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
