"""The context packet: ranked candidates packed into one shared budget, judged request by request."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators import evidence, ranking, selection
from weft.operators.threads import rendered_units
from weft.plans import packing

BUDGET, MOST_THREADS, HYDRATED = 12_000, 4, 12


def choose_all(rows: pd.DataFrame, budget: int) -> pd.DataFrame:
    """Packs threads in order of rank into equal shares, then gives what is left to them in the same order."""
    threads = [g for _, g in rows.sort_values(["rank", "pos"]).groupby("rank", sort=True)]
    share = budget // max(len(threads), 1)
    done = [packing.choose(g, share) for g in threads]
    left = budget - sum(int(d.loc[d["selected"], "units"].sum()) for d in done)
    for i, g in enumerate(threads):
        if done[i]["selected"].all():
            continue
        used = int(done[i].loc[done[i]["selected"], "units"].sum())
        more = packing.choose(g, used + left)
        now = int(more.loc[more["selected"], "units"].sum())
        if now > used:
            done[i], left = more, left - (now - used)
    out = pd.concat([d.assign(rank=int(g["rank"].iloc[0])) for d, g in zip(done, threads, strict=True)]) if done else rows.assign(selected=False)
    return out[["thread_id", "rank", "id", "pos", "units", "selected"]]


def chosen(candidates: DataFrame, most: int = MOST_THREADS) -> DataFrame:
    """(thread_id, rank, reasons and evidence) of the threads that a packet takes: the last place is kept for the best thin one."""
    few = ranking.order(candidates, HYDRATED)
    ordered = few.withColumns({"grp": F.lit(0), "ord": F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.array(*ranking.FULL_VECTOR)), "thread_id")), "thin": F.array_contains("reasons", "thin_thread")})
    places = ranking.thin_reserve(ordered.select("grp", "ord", "thin"), most).select("ord", F.col("place").alias("rank"))
    return ordered.join(F.broadcast(places), "ord").withColumn("selected", F.col("rank") <= most)


def packed(threads: DataFrame, posts: DataFrame, users: DataFrame, mention: Column, match: Column, budget: int = BUDGET) -> DataFrame:
    """(thread_id, rank, id, pos, units, selected): only ids and sizes of the chosen threads meet in one task, as the budget is one."""
    few = F.broadcast(threads.where("selected").select("thread_id", "rank"))  # at most MOST_THREADS rows
    own = posts.join(few.select("thread_id"), "thread_id", "left_semi")
    rows = packing.priorities(own, mention, match).join(rendered_units(own, users), "id").join(few, "thread_id").select("thread_id", "id", "pos", "priority", "units", "rank")
    return rows.withColumn("request", F.lit(0)).groupBy("request").applyInPandas(lambda g: choose_all(g, budget), "thread_id string, rank long, id string, pos long, units long, selected boolean")


def packet(threads: DataFrame, chosen_posts: DataFrame) -> DataFrame:
    """One row for each packed thread: totals, what was left out, the widest skip, and the evidence it was chosen by."""
    w = Window.partitionBy("thread_id").orderBy("pos")
    run = F.sum(F.col("selected").cast("int")).over(w)
    gaps = chosen_posts.withColumn("run", run).where(~F.col("selected")).groupBy("thread_id", "run").agg(F.count(F.lit(1)).alias("n")).groupBy("thread_id").agg(F.max("n").alias("largest_skip"))
    by = chosen_posts.groupBy("thread_id", "rank").agg(F.count(F.lit(1)).alias("total_posts"), F.count_if(~F.col("selected")).alias("omitted_posts"), F.coalesce(F.sum(F.when(F.col("selected"), F.col("units"))), F.lit(0)).alias("units"))
    own = threads.select("thread_id", "reasons", "density", "root_anchored", "exclusive", "dominated")
    return by.join(gaps, "thread_id", "left").join(own, "thread_id").withColumns({"request": F.lit(0), "largest_skip": F.coalesce("largest_skip", F.lit(0)), "pending": F.lit(False)})


def context(candidates: DataFrame, posts: DataFrame, users: DataFrame, mention: Column, match: Column, budget: int = BUDGET, most: int = MOST_THREADS) -> DataFrame:
    """The packet of one request with each thread's place, totals, whether it is the primary one and worth reading in full."""
    threads = chosen(evidence.reasons(candidates), most).persist()  # a dozen rows, read several times
    rows = packet(threads, packed(threads, posts, users, mention, match, budget))
    full = F.coalesce(selection.recommends_full(), F.lit(False))
    return rows.join(selection.primary_threads(rows), "request").select("thread_id", "rank", "total_posts", "omitted_posts", "units", "largest_skip", (F.col("thread_id") == F.col("primary")).alias("is_primary"), full.alias("recommend_full"), F.array_join("reasons", "|").alias("reasons"))
