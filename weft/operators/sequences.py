"""Operators over a thread's posts in order: islands, windows, segments, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def thread_order():
    return Window.partitionBy("thread_id").orderBy("create_at", "id")


def placed(posts: DataFrame) -> DataFrame:
    return posts.withColumn("pos", F.row_number().over(thread_order()).cast("long"))


def densest_window(rows: DataFrame, key: str, at: str, order: str, width_ms: int = 3_600_000, least: int = 3) -> DataFrame:
    """The window of the given width with most rows; the earliest of equals; not the whole group, and at least `least` rows."""
    counted = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key).orderBy(at).rangeBetween(0, width_ms)))
    best = counted.groupBy(key).agg(F.max_by(F.struct(F.col("n"), F.col(at).alias("start_at"), F.col(order).alias("first_id")), F.struct(F.col("n"), -F.col(at), -F.col(order))).alias("b"), F.count(F.lit(1)).alias("total"))
    return best.select(key, F.col("b.n").alias("n"), F.col("b.start_at").alias("start_at"), F.col("b.first_id").alias("first_id"), "total").where((F.col("n") >= least) & (F.col("n") < F.col("total")))


def covered(posts: DataFrame, hit: Column, radius: int) -> DataFrame:
    """Posts with pos, hit and cov (1 within the radius of a hit)."""
    p = placed(posts).withColumn("hit", F.coalesce(hit, F.lit(False)).cast("int"))
    return p.withColumn("cov", F.max("hit").over(thread_order().rowsBetween(-radius, radius)))


def islands(rows: DataFrame, merge_gap: int = 2) -> DataFrame:
    """Runs of covered posts; gaps of at most merge_gap posts are bridged."""
    inside = rows.where("cov = 1")
    w = Window.partitionBy("thread_id").orderBy("pos")
    new = F.when(F.col("pos") - F.lag("pos").over(w) - 1 > merge_gap, 1).otherwise(0)
    marked = inside.withColumn("new", new).withColumn("island", F.sum("new").over(w))
    return marked.groupBy("thread_id", "island").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.sum("hit").cast("long").alias("hits"))


def density(rows: DataFrame) -> DataFrame:
    return rows.groupBy("thread_id").agg(F.round(F.avg(F.col("cov").cast("double")), 2).alias("density"), F.sum("hit").cast("long").alias("hits"))


def timeline_skips(rows: DataFrame) -> DataFrame:
    """Runs of posts left out: how many, between which posts, when."""
    w = Window.partitionBy("thread_id").orderBy("pos")
    run = rows.withColumn("grp", F.col("pos") - F.row_number().over(Window.partitionBy("thread_id", "cov").orderBy("pos"))).withColumn("before", F.lag("id").over(w)).withColumn("after", F.lead("id").over(w))
    return run.where("cov = 0").groupBy("thread_id", "grp").agg(F.count(F.lit(1)).alias("skipped"), F.min("create_at").alias("from_at"), F.max("create_at").alias("to_at"), F.min_by("before", "pos").alias("after_id"), F.max_by("after", "pos").alias("before_id")).drop("grp")


def author_runs(posts: DataFrame) -> DataFrame:
    """Runs of consecutive live posts by one author."""
    live = posts.where("delete_at = 0")
    new = F.when(F.lag("user_id").over(thread_order()).eqNullSafe(F.col("user_id")), 0).otherwise(1)
    return live.withColumn("new", new).withColumn("run", F.sum("new").over(thread_order())).groupBy("thread_id", "run").agg(F.min("user_id").alias("user_id"), F.count(F.lit(1)).alias("posts"), F.min("id").alias("first_id")).withColumn("run", F.col("run").cast("long"))


def outcome_window(posts: DataFrame, mention: Column, tail: int = 3, live: bool = False) -> DataFrame:
    """The last posts behind a thread's last mention of the subject; live: without tombstones."""
    p = placed(posts).withColumn("m", F.when(mention, F.col("pos")))
    last = p.groupBy("thread_id").agg(F.max("m").alias("last_mention"))
    after = p.join(last, "thread_id").where("pos > last_mention")
    if live:
        after = after.where("delete_at = 0")
    back = F.row_number().over(Window.partitionBy("thread_id").orderBy(F.desc("pos")))
    return after.withColumn("back", back.cast("long")).where(F.col("back") <= tail).select("thread_id", "id", "back")


def replies_after(posts: DataFrame) -> DataFrame:
    """For each live post the live posts behind it by other authors: all behind it, less the author's own."""
    live = posts.where("delete_at = 0")
    own = Window.partitionBy("thread_id", "user_id").orderBy("create_at", "id")
    ahead = (1, Window.unboundedFollowing)
    n = F.count(F.lit(1)).over(thread_order().rowsBetween(*ahead)) - F.count(F.lit(1)).over(own.rowsBetween(*ahead))
    return live.select("id", n.alias("replies_after"))


def around(posts: DataFrame, anchor: Column, before: int, after: int) -> DataFrame:
    """Posts within a span of an anchor post, by frames over one ordering."""
    p = placed(posts).withColumn("a", F.coalesce(anchor, F.lit(False)).cast("int"))
    near = F.max("a").over(thread_order().rowsBetween(-after, before))
    return p.withColumn("near", near).where("near = 1").select("thread_id", "id", "pos")


def latest(posts: DataFrame, k: int = 3) -> DataFrame:
    back = F.row_number().over(Window.partitionBy("thread_id").orderBy(F.desc("create_at"), F.desc("id")))
    return posts.where("delete_at = 0").withColumn("back", back.cast("long")).where(F.col("back") <= k).select("thread_id", "id", "back")


def covering_window(tokens: DataFrame, terms: list[str]) -> DataFrame:
    """The shortest token span of each post that holds all terms. tokens: (id, pos, token)."""
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    hits = tokens.where(F.col("token").isin(terms))
    lasts = [F.max(F.when(F.col("token") == t, F.col("pos"))).over(w) for t in terms]
    least = F.least(*lasts) if len(lasts) > 1 else lasts[0]
    some_missing = F.array_contains(F.array(*[x.isNull() for x in lasts]), True)
    return hits.withColumn("span", F.when(~some_missing, F.col("pos") - least + 1)).groupBy("id").agg(F.min("span").alias("span")).where("span IS NOT NULL")


def nearest_distance(posts: DataFrame, a: Column, b: Column) -> DataFrame:
    """(thread_id, distance): posts between the closest pair of an a and a b post, by looking back and ahead once."""
    p = placed(posts).withColumns({"a": F.coalesce(a, F.lit(False)), "b": F.coalesce(b, F.lit(False))})
    here = Window.currentRow
    back = F.max(F.when(F.col("b"), F.col("pos"))).over(thread_order().rowsBetween(Window.unboundedPreceding, here))
    ahead = F.min(F.when(F.col("b"), F.col("pos"))).over(thread_order().rowsBetween(here, Window.unboundedFollowing))
    near = p.withColumn("d", F.least(F.col("pos") - back, ahead - F.col("pos"))).where("a AND d IS NOT NULL")
    return near.groupBy("thread_id").agg(F.min("d").alias("distance"))


def bridged(posts: DataFrame, chosen: Column, merge_gap: int = 2) -> DataFrame:
    """(thread_id, id, chosen, kept): posts chosen, or in a gap of at most merge_gap posts between two chosen ones."""
    p = placed(posts).withColumn("chosen", F.coalesce(chosen, F.lit(False)))
    at = F.when(F.col("chosen"), F.col("pos"))
    back = F.max(at).over(thread_order().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.min(at).over(thread_order().rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return p.withColumn("kept", F.col("chosen") | F.coalesce(ahead - back - 1 <= merge_gap, F.lit(False))).select("thread_id", "id", "chosen", "kept")


def core_span(posts: DataFrame, hit: Column) -> DataFrame:
    """(thread_id, first_pos, last_pos, inside, holes): from the first hit to the last, and how many posts between are none."""
    p = placed(posts).withColumn("hit", F.coalesce(hit, F.lit(False)))
    ends = p.where("hit").groupBy("thread_id").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count(F.lit(1)).alias("hits"))
    return ends.select("thread_id", "first_pos", "last_pos", (F.col("last_pos") - F.col("first_pos") + 1).alias("inside"), (F.col("last_pos") - F.col("first_pos") + 1 - F.col("hits")).alias("holes"))


def chronology(items: DataFrame) -> DataFrame:
    """Items of several threads in one order of time; one without a time borrows that of the item before it, or else behind it, in its thread."""
    w = Window.partitionBy("thread_id").orderBy("pos")
    back = F.last("at", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.first("at", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return items.withColumn("at", F.coalesce(back, ahead)).orderBy("at", "thread_id", "pos")
