"""A stream of post pages into the index: pages are files of any store that Spark reads, and every micro-batch is one version of the index.

Pages lie as `<path>/channel=<c>/page=<n>/...`, each a JSON object with `order` (ids) and `posts`
(by id), as an API gives them. Spark's file source keeps track of which were read. A micro-batch
is committed with the posts it brings, the checkpoints of their channels and its own number, all
under one manifest: whatever is lost in between, a repeated batch changes nothing.

A channel whose page is broken, names another channel, or brings too much keeps its
checkpoint, with the reason beside it, and what its pages before the broken one brought; other channels go on. Its next
good batch clears the reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.index import PostIndex

MOST_DELTA = 1000
POST = "id string, root_id string, channel_id string, user_id string, message string, create_at bigint, update_at bigint, delete_at bigint, file_ids array<string>"
PAGE = f"order array<string>, posts map<string, struct<{', '.join(c.replace(' ', ': ', 1) for c in POST.split(', '))}>>"
FILES = "value string, channel string, page int"


def parsed(pages: DataFrame) -> DataFrame:
    """(channel, page, error, post): a row for each post in the order of its page, one with the error for each page that is none.

    Ids without a post are left out; posts without their id, with times below zero or of another channel break the page.
    """
    read = pages.select("channel", "page", F.from_json("value", PAGE).alias("p"))
    listed = F.filter(F.transform("p.order", lambda i: F.struct(i.alias("i"), F.element_at("p.posts", i).alias("post"))), lambda x: x["post"].isNotNull())
    read = read.withColumn("listed", listed)
    wrong = lambda x: ~x["post"]["id"].eqNullSafe(x["i"]) | (F.least(*(F.coalesce(x["post"][c], F.lit(0)) for c in ("create_at", "update_at", "delete_at"))) < 0)
    error = F.when(F.col("p.order").isNull() | F.col("p.posts").isNull(), "no page").when(F.exists("listed", wrong), "not a post").when(F.exists("listed", lambda x: x["post"]["channel_id"] != F.col("channel")), "another channel")
    posts = F.when(F.col("error").isNotNull(), F.array(F.lit(None).cast(f"struct<{', '.join(c.replace(' ', ': ', 1) for c in POST.split(', '))}>"))).otherwise(F.transform("listed", lambda x: x["post"]))
    return read.withColumn("error", error).select("channel", "page", "error", F.explode(posts).alias("post"))


def page_stream(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    return parsed(spark.readStream.schema(FILES).option("wholetext", True).option("maxFilesPerTrigger", files_a_batch).text(path))


def index_posts(rows: DataFrame) -> DataFrame:
    """Posts as the index takes them."""
    zero = lambda c: F.coalesce(f"post.{c}", F.lit(0)).alias(c)
    thread = F.when(F.coalesce("post.root_id", F.lit("")) == "", F.col("post.id")).otherwise(F.col("post.root_id"))
    return rows.select("post.id", F.coalesce("post.root_id", F.lit("")).alias("root_id"), thread.alias("thread_id"), F.col("channel").alias("conversation_id"), F.coalesce("post.user_id", F.lit("")).alias("user_id"), zero("create_at"), zero("update_at"), zero("delete_at"), F.coalesce("post.message", F.lit("")).alias("message"))


def to_enrich(rows: DataFrame, index: PostIndex) -> DataFrame:
    """(kind, id): users and files that posts name and the index does not hold yet, to be fetched by whoever can."""
    named = rows.select(F.lit("user").alias("kind"), F.col("post.user_id").alias("id")).unionByName(rows.select(F.lit("file").alias("kind"), F.explode("post.file_ids").alias("id")))
    held = index.table("users").select(F.lit("user").alias("kind"), "id").unionByName(index.table("files").select(F.lit("file").alias("kind"), "id"))
    return named.where("id IS NOT NULL AND id <> ''").distinct().join(held, ["kind", "id"], "left_anti")


class PageSync:
    """For foreachBatch: what a micro-batch does to the index. most: posts of one channel from which on its delta is refused; None: all are taken."""

    def __init__(self, index: PostIndex, now_ms: int, most: int | None = MOST_DELTA):
        self.index, self.now_ms, self.most = index, now_ms, most

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        if self.index.meta().get("epoch", -1) >= epoch:
            return  # it was committed before the writer was lost
        broken = batch.where("error IS NOT NULL").groupBy("channel").agg(F.min("page").alias("broken_at"), F.min_by("error", "page").alias("why"))
        sound = batch.where("error IS NULL").join(broken, "channel", "left").where("broken_at IS NULL OR page < broken_at")
        refused = F.col("n") >= (self.most if self.most is not None else 1 << 62)
        counts = sound.groupBy("channel").agg(
            F.count_distinct("post.id").alias("n"), F.max(F.struct("post.create_at", "post.id")).alias("newest"), F.min("post.create_at").alias("oldest"),
        )
        taken = sound.join(counts.where(~refused).select("channel"), "channel", "left_semi")
        old = self.index.table("checkpoints").withColumnRenamed("conversation_id", "channel")
        state = counts.join(broken, "channel", "full").join(old, "channel", "left")
        error = F.when(F.col("why").isNotNull(), F.col("why")).when(refused, "too many changes")
        newer = refused.eqNullSafe(F.lit(False)) & (F.col("newest_post_at").isNull() | (F.col("newest.create_at") >= F.col("newest_post_at")))
        state = state.select(
            F.col("channel").alias("conversation_id"),
            F.when(newer, F.col("newest.id")).otherwise(F.col("newest_post_id")).alias("newest_post_id"),
            F.when(newer, F.col("newest.create_at")).otherwise(F.col("newest_post_at")).alias("newest_post_at"),
            F.when(refused.eqNullSafe(F.lit(False)), F.least("oldest", "oldest_covered_at")).otherwise(F.col("oldest_covered_at")).alias("oldest_covered_at"),
            F.when(error.isNull(), F.lit(self.now_ms)).otherwise(F.col("last_success_at")).alias("last_success_at"),
            error.alias("error"),
        )
        self.index.update(index_posts(taken), checkpoints=state, meta={"epoch": epoch})


def sync(spark: SparkSession, path: str, index: PostIndex, checkpoint: str, now_ms: int, most: int | None = MOST_DELTA, files_a_batch: int = 100) -> None:
    """Reads all pages that are there, in micro-batches, and stops."""
    stream = page_stream(spark, path, files_a_batch)
    stream.writeStream.foreachBatch(PageSync(index, now_ms, most)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
