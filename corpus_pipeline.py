"""The corpus pipeline: quality rules, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet
and read again as the next stage's docs. All but the last keep the columns of documents.

* quality rules: documents that the rules reject go.
* n-gram Jaccard join: of each component of linked documents the smallest id stays.
  Documents without words are linked with nothing and stay.
* substring dedup: words in 20-word windows that start earlier, in what the stage before
  kept, are cut out; n_chars follows the text. Documents that lose all words go.
* best-fit packing: pieces of what is left, in sequences of at most 2048 tokens.

An empty table goes through every stage and gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.best_fit import best_fit_packing
from weft.llm.exchange import cut
from weft.llm.jaccard_groups import keep_one_of_each
from weft.llm.quality_rules import keep_good
from weft.llm.substring_dedup import remove_repeats
from weft.llm.vocabularies import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = remove_repeats(docs, drop_emptied=True)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("substring dedup", repeated_passages), ("best-fit packing", packing)]

#: The tokenizer and the window search have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
