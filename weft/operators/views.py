"""Output shapes: what a reader of threads, searches and people gets, as projections and small aggregates."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import text as T

LIVE = "delete_at = 0"


def messages(posts: DataFrame, users: DataFrame, most: int = 240) -> DataFrame:
    """(id, thread_id, author, at, text, deleted): posts as messages, redacted and cut."""
    named = posts.join(users.select(F.col("id").alias("user_id"), "username"), "user_id", "left")
    return named.select("id", "thread_id", F.coalesce("username", F.concat(F.lit("unknown:"), "user_id")).alias("author"), T.iso_time(F.col("create_at")).alias("at"), T.excerpt(F.col("message"), most).alias("text"), (F.col("delete_at") != 0).alias("deleted"))


def bodies(posts: DataFrame, files: DataFrame, most_files: int = 50) -> DataFrame:
    """One row for each thread: size, span, last post, authors in order of first appearance, and its live files up to a number."""
    by = posts.groupBy("thread_id").agg(
        F.count(F.lit(1)).alias("posts"), F.count_if(F.col("delete_at") == 0).alias("live"), F.min("create_at").alias("from_at"), F.max("create_at").alias("to_at"), F.max_by("id", F.struct("create_at", "id")).alias("last_id"),
    )
    first = posts.where(LIVE).groupBy("thread_id", "user_id").agg(F.min(F.struct("create_at", "id")).alias("f")).groupBy("thread_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "user_id"))), lambda x: x["user_id"]).alias("authors"))
    held = files.where(LIVE).select(F.col("post_id").alias("id"), F.col("name"), F.col("id").alias("file_id")).join(posts.where(LIVE).select("id", "thread_id"), "id").groupBy("thread_id").agg(F.array_sort(F.collect_list(F.struct("file_id", "name"))).alias("files"))
    out = by.join(first, "thread_id", "left").join(held, "thread_id", "left").withColumn("n_files", F.coalesce(F.size("files"), F.lit(0)))
    return out.withColumns({"files": F.transform(F.slice(F.coalesce("files", F.array().cast("array<struct<file_id:string,name:string>>")), 1, most_files), lambda x: x["file_id"]), "files_omitted": F.greatest(F.lit(0), F.col("n_files") - most_files)})


def brief_timeline(posts: DataFrame, kept: DataFrame) -> DataFrame:
    """(thread_id, item, kind, first_id, last_id, posts): kept posts one by one, and one skip for each run of the others."""
    w = Window.partitionBy("thread_id").orderBy("create_at", "id")
    rows = posts.join(kept.select("id").distinct().withColumn("kept", F.lit(True)), "id", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    new = F.when(F.col("kept") | F.coalesce(F.lag("kept").over(w), F.lit(True)), 1).otherwise(0)
    rows = rows.withColumn("item", F.sum(new).over(w))
    by = rows.groupBy("thread_id", "item").agg(F.bool_and("kept").alias("kept"), F.min_by("id", F.struct("create_at", "id")).alias("first_id"), F.max_by("id", F.struct("create_at", "id")).alias("last_id"), F.count(F.lit(1)).alias("posts"))
    return by.select("thread_id", "item", F.when(F.col("kept"), "post").otherwise("brief_projection").alias("kind"), "first_id", "last_id", "posts")


def search_rows(hits: DataFrame, most: int = 10, most_excerpts: int = 3, most_probes: int = 12) -> DataFrame:
    """(request, thread_id, place, probes, excerpts, omitted): the best threads of each request's hits (request, thread_id, id, probe, score, text), with a few distinct excerpts.

    Tasks cut each request to its best threads before these are shuffled by request.
    """
    texts = hits.groupBy("request", "thread_id", "text").agg(F.min(F.struct("score", "id")).alias("b"))
    shown = texts.groupBy("request", "thread_id").agg(F.array_sort(F.collect_list(F.struct("b", "text"))).alias("t"))
    place = F.row_number().over(Window.partitionBy("request").orderBy("best", "thread_id"))
    by = hits.groupBy("request", "thread_id").agg(F.min("score").alias("best"), F.slice(F.array_sort(F.collect_set("probe")), 1, most_probes).alias("probes"))
    by = by.withColumn("place", place).where(F.col("place") <= most).join(shown, ["request", "thread_id"])
    return by.select("request", "thread_id", "place", "probes", F.transform(F.slice("t", 1, most_excerpts), lambda x: x["text"]).alias("excerpts"), F.greatest(F.lit(0), F.size("t") - most_excerpts).alias("omitted"))


def people(activity: DataFrame, most: float | None = None) -> DataFrame:
    """Authors by falling number of posts; no finite number is no limit, and at least one is given."""
    ordered = activity.orderBy(F.desc("post_count"), "user_id")
    return ordered if most is None or most != most or most in (float("inf"), float("-inf")) else ordered.limit(max(1, int(most)))


def reading_order(packet: DataFrame) -> DataFrame:
    """(request, thread_id, place): the primary thread first, then by rank."""
    w = Window.partitionBy("request").orderBy((F.col("thread_id") != F.col("primary")).cast("int"), "rank", "thread_id")
    return packet.select("request", "thread_id", F.row_number().over(w).alias("place"))


def inspected(files: DataFrame, results: DataFrame) -> DataFrame:
    """(file_id, name, status, trust): live files with what an inspection (file_id, status) found; never trusted."""
    return files.where(LIVE).select(F.col("id").alias("file_id"), "name").join(results, "file_id", "left").select("file_id", "name", F.coalesce("status", F.lit("not_inspected")).alias("status"), F.lit("low").alias("trust"))


def identities(configured: DataFrame, seen: DataFrame) -> DataFrame:
    """(alias, status): configured conversations (alias, id, name) against seen ones (id, name): ok, renamed, missing, or not the same id under that name."""
    by_id = seen.select("id", F.col("name").alias("seen_name"))
    by_name = seen.select("name", F.col("id").alias("other_id"))
    rows = configured.join(by_id, "id", "left").join(by_name, "name", "left")
    status = F.when(F.col("seen_name") == F.col("name"), "ok").when(F.col("seen_name").isNotNull(), "renamed").when(F.col("other_id").isNotNull(), "other_id").otherwise("missing")
    return rows.select("alias", status.alias("status"))


def unfetched(posts: DataFrame, users: DataFrame, wanted_files: DataFrame, files: DataFrame) -> DataFrame:
    """(kind, id): authors and files that a page of posts names and the index does not hold yet; wanted_files: (post_id, id)."""
    people_ = posts.select(F.col("user_id").alias("id")).distinct().join(users.select("id"), "id", "left_anti").select(F.lit("user").alias("kind"), "id")
    named = wanted_files.join(posts.select(F.col("id").alias("post_id")), "post_id", "left_semi").select("id").distinct().join(files.select("id"), "id", "left_anti")
    return people_.unionByName(named.select(F.lit("file").alias("kind"), "id"))


def packing_totals(packed: DataFrame) -> DataFrame:
    """(thread_id, returned, omitted, units): rows (thread_id, selected, units)."""
    return packed.groupBy("thread_id").agg(F.count_if("selected").alias("returned"), F.count_if(~F.col("selected")).alias("omitted"), F.coalesce(F.sum(F.when(F.col("selected"), F.col("units"))), F.lit(0)).cast("long").alias("units"))


def token_snippet(text: Column, word: str, most: int = 24) -> Column:
    """A window of tokens that begins a third before the first match, with ellipses where it is cut; the head if nothing matches."""
    toks = T.tokens(text)
    at = F.greatest(F.array_position(toks, word.lower()).cast("int") - 1 - most // 3, F.lit(0))
    start = F.least(at, F.greatest(F.size(toks) - most, F.lit(0)))
    body = F.array_join(F.slice(toks, start + 1, most), " ")
    return F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(start + most < F.size(toks), "…").otherwise(""))


def concept_of(values: DataFrame, concepts: dict[str, list[str]]) -> DataFrame:
    """(value, concept, alias): the longest alias that a value holds, the smaller one of equals."""
    low = F.lower("value")
    found = [F.when(T.contains_exact(low, a.lower()), F.struct((-F.lit(len(a))).alias("n"), F.lit(a).alias("alias"), F.lit(c).alias("concept"))) for c, aliases in sorted(concepts.items()) for a in aliases]
    best = F.get(F.array_sort(F.array_compact(F.array(*found))), F.lit(0))
    return values.withColumn("b", best).where("b IS NOT NULL").select("value", "b.concept", "b.alias")


def image_texts(images: DataFrame, extract: Callable[[bytes], str | None] | None = None) -> DataFrame:
    """(path, text, status): texts of images (path, content) by a function that the caller gives; without one they are not interpreted."""
    if extract is None:
        return images.select("path", F.lit(None).cast("string").alias("text"), F.lit("not_interpreted").alias("status"))

    @F.pandas_udf("string")
    def read(content: pd.Series) -> pd.Series:
        return content.map(lambda c: None if c is None else extract(bytes(c)))

    text = read("content")
    return images.select("path", text.alias("text")).withColumn("status", F.when(F.col("text").isNull(), "not_interpreted").otherwise("text_extracted"))
