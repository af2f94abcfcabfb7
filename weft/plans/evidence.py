"""How complete and how current the evidence is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STALE_SECONDS = 300


def status(posts: DataFrame, now_ms: int) -> DataFrame:
    """One row for each conversation: size, currency, and whether decisions or open questions were found. One aggregate."""
    live = F.col("delete_at") == 0
    has = lambda x: F.count_if(live & F.col("message").contains(x)) > 0
    age = (F.lit(now_ms) - F.max("create_at")) / 1000
    return posts.groupBy("conversation_id").agg(
        F.countDistinct("thread_id").alias("threads"),
        F.count_if(live).alias("live_posts"),
        F.max("create_at").alias("newest_at"),
        F.when(age > STALE_SECONDS, "stale").otherwise("current").alias("currency"),
        F.when(has("approved"), "decided").when(has("unclear"), "open").otherwise("thin").alias("adequacy"),
    )


def next_steps(row: dict) -> list[dict]:
    """Ordered steps that would improve a packet: what is missing first, then what is old, then what was left out."""
    steps = []
    if row.get("adequacy") == "thin":
        steps.append({"step": "widen", "priority": 1, "why": "no decision or question was found"})
    if row.get("currency") == "stale":
        steps.append({"step": "sync", "priority": 2, "why": "newer posts may exist"})
    skipped, total = row.get("omitted", 0), row.get("posts", 0)
    if total and (skipped / total >= 0.25 or row.get("largest_skip", 0) >= 5):
        steps.append({"step": "full_thread", "priority": 3, "why": f"{skipped} of {total} posts were left out"})
    return steps
