"""Lookups, joins, filters and aggregates over posts, users and files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import text as T

LIVE = "delete_at = 0"


def thread_posts(posts: DataFrame, thread_id: str) -> DataFrame:
    """A thread's posts in order, tombstones included."""
    return posts.where(F.col("thread_id") == thread_id).orderBy("create_at", "id")


def people_activity(posts: DataFrame, users: DataFrame) -> DataFrame:
    """Live posts and last activity of each known author."""
    counts = posts.where(LIVE).groupBy("user_id").agg(F.count(F.lit(1)).alias("post_count"), F.max("create_at").alias("last_post_at"))
    return counts.join(users, F.col("user_id") == users["id"]).select("user_id", "username", "post_count", "last_post_at")


def reply_counts(posts: DataFrame) -> DataFrame:
    """Live replies of each thread, its root left out."""
    return posts.groupBy("thread_id").agg(F.count_if((F.col("delete_at") == 0) & (F.col("id") != F.col("thread_id"))).alias("replies"))


def ticket_edges(posts: DataFrame) -> DataFrame:
    """(ticket_key, thread_id, source_post_id): each key of each thread once, with the first post that names it."""
    keys = posts.where(LIVE).select("thread_id", "id", F.explode(T.ticket_keys(F.col("message"))).alias("ticket_key"))
    return keys.groupBy("ticket_key", "thread_id").agg(F.min("id").alias("source_post_id"))


def ticket_conversations(edges: DataFrame, posts: DataFrame) -> DataFrame:
    return edges.join(posts.select(F.col("id").alias("source_post_id"), "conversation_id"), "source_post_id").select("ticket_key", "conversation_id").distinct()


def filter_threads(posts: DataFrame, user: str | None = None, after: int | None = None, before: int | None = None) -> DataFrame:
    """Threads with one live post that meets all of: author, not before after, before before."""
    ok: Column = F.col("delete_at") == 0
    if user is not None:
        ok &= F.lower("user_id") == user.lstrip("@").lower()
    if after is not None:
        ok &= F.col("create_at") >= after
    if before is not None:
        ok &= F.col("create_at") < before
    return posts.where(ok).select("thread_id").distinct()


def filter_threads_by_file(posts: DataFrame, files: DataFrame, pattern: str) -> DataFrame:
    """Threads in which a live post has a live file whose name holds the pattern."""
    named = files.where((F.col("delete_at") == 0) & F.lower("name").contains(pattern.lower())).select(F.col("post_id").alias("id"))
    return posts.where(LIVE).join(named, "id", "left_semi").select("thread_id").distinct()


def without_automation(posts: DataFrame, users: DataFrame) -> DataFrame:
    """Threads, without those that a bot began and nobody answered."""
    bots = users.where("is_bot").select(F.col("id").alias("user_id"))
    begun_by_bot = posts.where("root_id = ''").join(bots, "user_id", "left_semi").select("thread_id")
    silent = reply_counts(posts).where("replies = 0").select("thread_id")
    return posts.select("thread_id").distinct().join(begun_by_bot.join(silent, "thread_id", "left_semi"), "thread_id", "left_anti")


def preceding_roots(posts: DataFrame, k: int = 3) -> DataFrame:
    """For each live root the k live roots of its conversation just before it: lags over one ordering, not a range join."""
    w = Window.partitionBy("conversation_id").orderBy("create_at", "id")
    roots = posts.where(LIVE).where("root_id = ''").select("conversation_id", "id", "create_at")
    before = roots.withColumn("prior", F.array_compact(F.array(*[F.lag("id", i).over(w) for i in range(1, k + 1)])))
    return before.select("id", F.posexplode("prior").alias("back", "prior_id")).select("id", (F.col("back") + 1).cast("int").alias("back"), "prior_id")


def hydrate(posts: DataFrame, users: DataFrame, files: DataFrame) -> DataFrame:
    """Posts with their author's name (or unknown:<id>) and live attachments."""
    held = files.where(LIVE).groupBy("post_id").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("file_bytes"), F.min("name").alias("first_file"))
    named = posts.join(users.select(F.col("id").alias("user_id"), "username"), "user_id", "left").join(held, posts["id"] == held["post_id"], "left")
    return named.select("id", F.coalesce("username", F.concat(F.lit("unknown:"), "user_id")).alias("author"), F.coalesce("n_files", F.lit(0)).cast("long").alias("n_files"), F.coalesce("file_bytes", F.lit(0)).cast("long").alias("file_bytes"), "first_file")


def allowlist(configured: DataFrame, indexed: DataFrame) -> DataFrame:
    """Configured conversations that the index has, by falling priority."""
    return configured.join(indexed.select("id").distinct(), "id").select("id", "alias", "priority").orderBy(F.desc("priority"), "alias", "id")


def statistics(posts: DataFrame, files: DataFrame) -> DataFrame:
    return posts.agg(F.count(F.lit(1)).alias("posts"), F.count_if(F.col("delete_at") != 0).alias("tombstones"), F.countDistinct("thread_id").alias("threads")).crossJoin(files.agg(F.count(F.lit(1)).alias("files")))


def rendered_units(posts: DataFrame, users: DataFrame) -> DataFrame:
    """Code points that a post takes: author, time (24) and message."""
    named = posts.join(users.select(F.col("id").alias("user_id"), "username"), "user_id", "left")
    return named.select("id", (F.length(F.coalesce("username", F.lit(""))) + 24 + F.length("message")).cast("long").alias("units"))


def related_tickets(posts: DataFrame, subject: str) -> DataFrame:
    """Other tickets in the threads that name the subject: mentions, threads, first time."""
    edges = posts.where(LIVE).select("thread_id", "id", "create_at", F.explode(T.ticket_keys(F.col("message"))).alias("ticket_key"))
    about = edges.where(F.col("ticket_key") == subject).select("thread_id").distinct()
    other = edges.join(about, "thread_id", "left_semi").where(F.col("ticket_key") != subject)
    return other.groupBy("ticket_key").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("thread_id").alias("threads"), F.min("create_at").alias("first_at"), F.min_by("id", F.struct("create_at", "id")).alias("first_post"))


def dominant_ticket(posts: DataFrame, subject: str) -> DataFrame:
    """(thread_id, ticket_key, mentions): the ticket beside the subject that a thread's posts name most; the smaller key of equals."""
    keys = posts.where(LIVE).select("thread_id", F.explode(T.ticket_keys(F.col("message"))).alias("ticket_key")).where(F.col("ticket_key") != subject)
    counts = keys.groupBy("thread_id", "ticket_key").agg(F.count(F.lit(1)).alias("mentions"))
    return counts.groupBy("thread_id").agg(F.min_by(F.struct("ticket_key", "mentions"), F.struct(-F.col("mentions"), F.col("ticket_key"))).alias("b")).select("thread_id", "b.*")


def merge_candidates(*lists: DataFrame) -> DataFrame:
    """Lists of (thread_id, score, reasons, latest_at) by thread: the best score, all reasons, the latest activity."""
    rows = lists[0]
    for other in lists[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy("thread_id").agg(F.max("score").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))).alias("reasons"), F.max("latest_at").alias("latest_at"))


def entity_rollup(entities: DataFrame, most: int = 40) -> DataFrame:
    """The entities named by most posts, with the first post of each."""
    by = entities.groupBy("kind", "normalized_value").agg(F.count(F.lit(1)).alias("posts"), F.min("post_id").alias("first_post"))
    return by.orderBy(F.desc("posts"), "kind", "normalized_value").limit(most)


def dropped(seen: DataFrame, selected: DataFrame) -> DataFrame:
    return seen.join(selected.select("thread_id").distinct(), "thread_id", "left_anti")


def overlap_terms(posts: DataFrame, subject: str) -> DataFrame:
    """(id, shared): words over two letters that a post shares with the subject, without URLs and stop words."""
    from weft.functions.subjects import normalize

    words = [w for w in dict.fromkeys(re.findall(r"[^\W_]+", normalize(subject))) if len(w) > 2 and w not in T.STOP_WORDS]
    said = T.tokens(F.regexp_replace("message", T.URL, " "))
    return posts.where(LIVE).select("id", F.size(F.array_intersect(said, F.array(*[F.lit(w) for w in words]))).cast("long").alias("shared")).where("shared > 0")
