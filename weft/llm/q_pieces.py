"""Query op3. SQL cannot express the encoding; tests hold it against the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .piece_bpe import digest_documents
from .vocabularies import vocabulary


def op3_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("piece_bpe_32k.model"))


QUERIES = {"op3_piece_encoding": op3_piece_encoding}
ORACLES: dict[str, str] = {}
