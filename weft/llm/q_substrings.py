"""Query op1. SQL over all 20-word windows is too slow for whole tables; tests hold it against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .substring_dedup import digest_kept


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_kept(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_substring_dedup": op1_substring_dedup}
ORACLES: dict[str, str] = {}
