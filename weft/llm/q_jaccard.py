"""Query op4. SQL over all pairs that share a shingle is too slow for whole tables; tests hold it against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .jaccard_groups import jaccard_components


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_jaccard_join": op4_jaccard_join}
ORACLES: dict[str, str] = {}
