"""Query op6. SQL cannot express the tokenizer; tests check ids, gaps and the number of sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .best_fit import best_fit_packing
from .vocabularies import vocabulary


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("word_bpe_49k.json"))


QUERIES = {"op6_best_fit_packing": op6_best_fit_packing}
ORACLES: dict[str, str] = {}
