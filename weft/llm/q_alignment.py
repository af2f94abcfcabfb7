"""Query op11: two tokenizers aligned on every document. The tokenizers have no SQL; tests hold it against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .alignment import align_documents
from .vocabularies import vocabulary


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


QUERIES = {"op11_token_alignment": op11_token_alignment}
ORACLES: dict[str, str] = {}
