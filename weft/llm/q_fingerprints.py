"""Query op2. SQL cannot express the fingerprint; tests hold edits, lengths and likeness against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .fingerprints import with_next


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_fingerprints": op2_fingerprints}
ORACLES: dict[str, str] = {}
