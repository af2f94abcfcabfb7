"""Query op5. SQL cannot express the classes; tests hold counts and the base score against brute force, and the model on held-out text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .class_ngrams import class_scores


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_lm_scoring": op5_lm_scoring}
ORACLES: dict[str, str] = {}
