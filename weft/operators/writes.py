"""Upserts, tombstones, checkpoints and attachment planning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def versioned_upsert(rows: DataFrame, key: str = "id", arrival: str = "arrival") -> DataFrame:
    """The newest version of each key; on a tie the later arrival wins. max_by is pre-aggregated, so a hot key shuffles little."""
    version = F.struct(F.greatest("update_at", "delete_at"), F.col(arrival))
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("r")).select(key, "r.*")


def tombstones(rows: DataFrame) -> DataFrame:
    """Deleted posts keep their row and lose their message."""
    return rows.withColumn("message", F.when(F.col("delete_at") != 0, "").otherwise(F.col("message")))


def finalize_full_sync(posts: DataFrame, retained: DataFrame, conversation_id: str) -> DataFrame:
    """Posts after a full sync of one conversation: those of it that were not seen again go."""
    stale = posts.where(F.col("conversation_id") == conversation_id).select("id").join(retained.select("id"), "id", "left_anti")
    return posts.join(stale, "id", "left_anti")


def advance_checkpoints(posts: DataFrame) -> DataFrame:
    """Newest and oldest post of each conversation."""
    return posts.groupBy("conversation_id").agg(F.max_by("id", F.struct("create_at", "id")).alias("newest_post_id"), F.max("create_at").alias("newest_post_at"), F.min("create_at").alias("oldest_covered_at"))


def freshness(checkpoints: DataFrame, now_ms: int, most_seconds: int = 300) -> DataFrame:
    age = F.greatest(F.lit(0), F.floor((F.lit(now_ms) - F.col("newest_post_at")) / 1000)).cast("long")
    return checkpoints.select("conversation_id", age.alias("age_seconds"), (F.col("newest_post_at").isNull() | (age > most_seconds)).alias("stale"))


def entity_rows(posts: DataFrame, files: DataFrame) -> DataFrame:
    """(post_id, kind, normalized_value, value) of text, author and live attachments; the first of each key stays."""
    from weft.functions import text as T

    live = posts.where("delete_at = 0")
    said = live.select(F.col("id").alias("post_id"), F.lit(0).alias("ord"), F.explode(T.entities(F.col("message"))).alias("e")).select("post_id", "ord", "e.kind", "e.value")
    by = live.select(F.col("id").alias("post_id"), F.lit(1).alias("ord"), F.lit("username").alias("kind"), F.col("user_id").alias("value"))
    held = files.where("delete_at = 0").select("post_id", F.lit(2).alias("ord"), F.lit("attachment").alias("kind"), F.col("name").alias("value")).join(live.select(F.col("id").alias("post_id")), "post_id", "left_semi")
    return said.unionByName(by).unionByName(held).withColumn("normalized_value", F.lower("value")).groupBy("post_id", "kind", "normalized_value").agg(F.min_by("value", F.struct("ord", "value")).alias("value"))


def download_plan(files: DataFrame, most_files: int = 20, most_bytes: int = 50 << 20) -> DataFrame:
    """Status of each live file of a post's batch by its place and the bytes before it."""
    w = Window.partitionBy("post_id").orderBy("id")
    placed = files.where("delete_at = 0").withColumn("place", F.row_number().over(w)).withColumn("through", F.sum("size").over(w))
    status = F.when(F.col("place") > most_files, "too_many").when(F.col("through") > most_bytes, "over_budget").otherwise("download")
    return placed.select("id", "post_id", F.col("place").cast("long").alias("place"), F.col("through").cast("long").alias("through"), status.alias("status"))
