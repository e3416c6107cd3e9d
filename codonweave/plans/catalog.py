"""Named queries over the driver tables and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codonweave.plans import interval_queries, region_queries, sequence_queries, transcript_queries  # noqa: F401
from codonweave.plans.registry import QUERIES, SQL, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coding regions decoded from codon scores."""
    return QUERIES["coding_regions"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
