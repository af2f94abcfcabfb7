"""Retrieval and extraction quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranking_quality(ranked: DataFrame, k: int = 10) -> DataFrame:
    """(case, recall, rr, ndcg) of rows (case, rank, grade), where every graded item has a row."""
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + F.lit(1.0))
    ideal = F.row_number().over(Window.partitionBy("case").orderBy(F.desc("grade"), "rank"))
    rows = ranked.withColumn("ideal", ideal)
    best = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("ideal") + F.lit(1.0))
    top = F.col("rank") <= k
    out = rows.groupBy("case").agg(
        (F.count_if(top & (F.col("grade") > 0)) / F.greatest(F.count_if(F.col("grade") > 0), F.lit(1))).alias("recall"),
        F.coalesce(F.max(F.when(F.col("grade") > 0, 1.0 / F.col("rank"))), F.lit(0.0)).alias("rr"),
        F.coalesce(F.try_divide(F.sum(F.when(top, gain).otherwise(0.0)), F.sum(F.when(F.col("ideal") <= k, best).otherwise(0.0))), F.lit(0.0)).alias("ndcg"),
    )
    return out.select("case", *[F.round(c, 6).alias(c) for c in ("recall", "rr", "ndcg")])


def compare(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Added, removed and changed cases of two reports."""
    a, b = before.select(key, F.col(value).alias("old")), after.select(key, F.col(value).alias("new"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, status.alias("status"), F.round(F.col("new") - F.col("old"), 6).alias("delta"))


def precision_recall(rows: DataFrame) -> DataFrame:
    """(grp, precision, recall, f1) of rows (grp, expected boolean, found boolean)."""
    hit = F.count_if(F.col("expected") & F.col("found")).cast("double")
    p, r = F.try_divide(hit, F.count_if("found")), F.try_divide(hit, F.count_if("expected"))
    out = rows.groupBy("grp").agg(F.coalesce(p, F.lit(1.0)).alias("precision"), F.coalesce(r, F.lit(1.0)).alias("recall"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return out.select("grp", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f1, 6).alias("f1"))
