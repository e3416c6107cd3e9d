"""Spark jobs for coding-region discovery in genomes."""
