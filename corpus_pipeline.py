"""Corpus pipeline: quality rules, near-duplicate removal, decontamination, secret scans, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codonweave.llm import containment, near, packing, quality, secrets
from codonweave.session import discard, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text passes; null and empty texts go, of repeated rows all or none. All columns stay."""
    return quality.keep_good(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the least id; rows that repeat id and text are such copies, texts without words are not."""
    return near.drop_near(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that hold no benchmark item; null and empty texts hold none. All columns stay."""
    return containment.without(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with a mark for each secret in their texts; null texts stay null. All columns stay; n_chars follows the text."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row; a null or empty text is one piece of one id. Other columns are left out."""
    return packing.pieces(docs)


STAGES = [("quality_rules", quality_rules), ("jaccard_join", jaccard_join), ("decontamination", decontamination), ("secret_scans", secret_scans), ("packing", pack)]

#: The later stages tokenize and cut texts, which SQL can't express; tests compare them with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage makes of the documents table; none of an empty table. Each stage's table goes once the next is written."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
        if written is not None:
            discard(written)
        written = docs
    return docs
