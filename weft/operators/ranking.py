"""Candidate threads: features, a lexicographic score vector, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def thread_features(posts: DataFrame, subject: Column, terms: list[str]) -> DataFrame:
    """(thread_id and what the score vector needs) in one aggregate over live posts."""
    from weft.functions import text as T

    has = F.coalesce(subject, F.lit(False))
    root = F.col("id") == F.col("thread_id")
    words = F.array_intersect(T.tokens(F.col("message")), F.array(*[F.lit(t) for t in terms]))
    return posts.where("delete_at = 0").groupBy("thread_id").agg(
        F.max((has & root).cast("int")).alias("subject_in_root"),
        F.max((has & ~root).cast("int")).alias("subject_in_reply"),
        F.size(F.array_distinct(F.flatten(F.collect_set(words)))).alias("matched_terms"),
        F.least(F.lit(5), F.count_if(F.size(T.tokens(F.col("message"))) >= 6)).cast("int").alias("depth"),
        F.max("create_at").alias("latest_at"),
    )


VECTOR = ("subject_in_root", "subject_in_reply", "matched_terms", "fusion", "depth", "latest_at")


def rank(candidates: DataFrame, limit: int | None = None) -> DataFrame:
    """By falling score vector, then thread id; arrays compare element by element."""
    vector = F.array(*[F.col(c).cast("double") for c in VECTOR])
    ordered = candidates.withColumn("vector", vector).orderBy(F.desc("vector"), "thread_id")
    return (ordered.limit(limit) if limit else ordered).drop("vector")


def primary(candidates: DataFrame, group: str, score: str, order: str) -> DataFrame:
    """The best candidate of each group; the first of equals."""
    return candidates.groupBy(group).agg(F.max_by(order, F.struct(F.col(score), -F.col(order))).alias("primary"))


def thin_reserve(candidates: DataFrame, most: int) -> DataFrame:
    """The first most - 1 substantive candidates, then the best thin one, then the rest. candidates: (grp, ord, thin)."""
    w = Window.partitionBy("grp", "thin").orderBy("ord")
    n = F.row_number().over(w)
    tier = F.when(~F.col("thin") & (n <= most - 1), 0).when(F.col("thin") & (n == 1), 1).otherwise(2)
    ranked = candidates.withColumn("tier", tier)
    return ranked.select("grp", "ord", "thin", F.row_number().over(Window.partitionBy("grp").orderBy("tier", "ord")).cast("long").alias("place"))


#: The order of the full score vector; earlier places decide first.
FULL_VECTOR = (
    "direct", "explicit_ticket", "ticket_in_root", "ticket_in_reply", "ticket_focus", "subject_in_root", "phrase_in_root", "full_coverage", "matched_probes", "proximity_tier",
    "proximity_window", "structured_matches", "routing", "thread_depth", "fusion", "matched_terms", "phrase_in_reply", "priority", "latest_match_at", "latest_activity_at",
)


def order(rows: DataFrame, limit: int | None = None) -> DataFrame:
    ordered = rows.withColumn("vector", F.array(*FULL_VECTOR)).orderBy(F.desc("vector"), "thread_id").drop("vector")
    return ordered.limit(limit) if limit else ordered
