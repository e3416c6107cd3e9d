"""Codon score files as a stream: each file that arrives is parsed by the batch reader's expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codonweave.operators.hmm import usable_codons
from codonweave.sources.readers import parse_codon_scores


def stream_usable_codons(spark: SparkSession, folder: str, min_bls: float = 0.1, files_per_trigger: int = 100) -> DataFrame:
    """Aligned codons with enough branch length from new files of a folder; stateless, so any sink mode fits."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return usable_codons(parse_codon_scores(lines), min_bls)
