"""Query op12: near-duplicate vectors. The index has no SQL; tests hold it against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .vector_links import cosine_links


def op12_cosine_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op12_cosine_links": op12_cosine_links}
ORACLES: dict[str, str] = {}
