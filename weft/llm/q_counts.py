"""Query op10: tokens of each line of each document. SQL cannot express the encoding; tests hold it against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .token_counts import token_counts
from .vocabularies import vocabulary


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op10_token_counts": op10_token_counts}
ORACLES: dict[str, str] = {}
