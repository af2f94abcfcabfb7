"""Packing a thread into a character budget: priorities by windows, then a greedy pass within each thread.

The greedy pass skips posts that do not fit and goes on, so it is no running sum; it runs
in applyInPandas, one thread a group, over ids and sizes only (no message text).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators import sequences

BUDGET, RADIUS, LATEST, MERGE_GAP = 500, 2, 3, 2


def priorities(posts: DataFrame, mention: Column, match: Column, radius: int = RADIUS) -> DataFrame:
    """(thread_id, id, pos, priority): 0 root, 1 subject mentions, 2.. their rings, then matches and their rings, the latest, the rest."""
    p = sequences.placed(posts.where("delete_at = 0"))
    w = sequences.thread_order()
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    p = p.withColumns({"mention": flag(mention), "match": flag(match)})

    def ring(col: str) -> Column:
        near = F.lit(None).cast("int")
        for r in range(radius, 0, -1):
            near = F.when(F.max(col).over(w.rowsBetween(-r, r)) == 1, r).otherwise(near)
        return near

    back = F.row_number().over(Window.partitionBy("thread_id").orderBy(F.desc("pos")))
    p = p.withColumns({"m_ring": ring("mention"), "q_ring": ring("match"), "back": back})
    level = F.when(F.col("id") == F.col("thread_id"), 0).when(F.col("mention") == 1, 1).when(F.col("m_ring").isNotNull(), 1 + F.col("m_ring"))
    level = level.when(F.col("match") == 1, 2 + radius).when(F.col("q_ring").isNotNull(), 2 + radius + F.col("q_ring")).when(F.col("back") <= LATEST, 3 + 2 * radius).otherwise(4 + 2 * radius)
    return p.select("thread_id", "id", "pos", level.cast("int").alias("priority"), "back")


def choose(rows: pd.DataFrame, budget: int, merge_gap: int = MERGE_GAP) -> pd.DataFrame:
    """Takes posts by priority and place as long as they fit; then short gaps between taken posts; then the latest."""
    rows = rows.sort_values("pos").reset_index(drop=True)
    last = int(rows["priority"].max())
    taken, left = set(), budget

    def take(i: int) -> None:
        nonlocal left
        if i not in taken and rows.at[i, "units"] <= left:
            taken.add(i)
            left -= int(rows.at[i, "units"])

    for i in rows[rows["priority"] < last].sort_values(["priority", "pos"]).index:
        take(i)
    before = sorted(taken)
    for a, b in zip(before, before[1:], strict=False):
        if 1 < b - a <= merge_gap + 1:
            for i in range(a + 1, b):
                take(i)
    for i in reversed(rows.index):
        take(i)
    return rows.assign(selected=[i in taken for i in rows.index])[["thread_id", "id", "pos", "units", "selected"]]


def pack(posts: DataFrame, users: DataFrame, mention: Column, match: Column, budget: int = BUDGET) -> DataFrame:
    """(thread_id, id, pos, units, selected)"""
    from weft.operators.threads import rendered_units

    rows = priorities(posts, mention, match).join(rendered_units(posts, users), "id").select("thread_id", "id", "pos", "priority", "units")
    return rows.groupBy("thread_id").applyInPandas(lambda g: choose(g, budget), "thread_id string, id string, pos long, units long, selected boolean")


def timeline(packed: DataFrame) -> DataFrame:
    """Selected posts and one skip marker for each run of omitted ones, in order."""
    w = Window.partitionBy("thread_id").orderBy("pos")
    new = F.when(F.col("selected") | F.lag("selected").over(w).eqNullSafe(F.lit(True)) | F.lag("selected").over(w).isNull(), 1).otherwise(0)
    run = packed.withColumn("new", new).withColumn("item", F.sum("new").over(w))
    return run.groupBy("thread_id", "item").agg(F.min("pos").alias("pos"), F.bool_and("selected").alias("shown"), F.count(F.lit(1)).alias("posts"), F.sum("units").alias("units"))
