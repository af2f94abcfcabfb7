"""Routing of a request to conversations, in a cascade of hints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WEIGHTS = {"channels": 6, "scopes": 5, "repositories": 4, "tickets": 3, "widened": 2, "all": 1}


def route(conversations: DataFrame, channels: list[str] = (), scopes: list[str] = (), repositories: list[str] = (), ticket_conversations: DataFrame | None = None) -> DataFrame:
    """(id, alias, priority, evidence): explicit channels alone, else the first hint that meets any conversation, else all."""
    if channels:
        return _labelled(conversations.where(F.col("alias").isin(list(channels))), "channels")
    steps = []
    if scopes:
        steps.append((conversations.where(F.arrays_overlap("scopes", _array(scopes))), "scopes"))
    if repositories:
        steps.append((conversations.where(F.arrays_overlap("repositories", _array(repositories))), "repositories"))
    if ticket_conversations is not None:
        steps.append((conversations.join(ticket_conversations.select(F.col("conversation_id").alias("id")), "id", "left_semi"), "tickets"))
    steps.append((conversations, "all"))
    tried = None
    for i, (rows, label) in enumerate(steps):
        rows = _labelled(rows, label).withColumn("step", F.lit(i))
        tried = rows if tried is None else tried.unionByName(rows)
    # The configuration is a small table: the first step with any row wins.
    first = tried.agg(F.min("step").alias("first"))
    return tried.crossJoin(F.broadcast(first)).where("step = first").drop("step", "first")


def widen(conversations: DataFrame, searched: DataFrame) -> DataFrame:
    return _labelled(conversations.join(searched.select("id"), "id", "left_anti"), "widened")


def unmatched(conversations: DataFrame, field: str, hints: list[str]) -> DataFrame:
    """Hints that no conversation has."""
    spark = conversations.sparkSession
    have = conversations.select(F.explode(field).alias("hint")).distinct()
    return spark.createDataFrame([(h,) for h in hints], "hint string").distinct().join(have, "hint", "left_anti")


def _array(values):
    return F.array(*[F.lit(v) for v in values])


def _labelled(rows: DataFrame, label: str) -> DataFrame:
    return rows.select("id", "alias", "priority", F.lit(label).alias("evidence"), F.lit(WEIGHTS[label]).alias("weight"))
