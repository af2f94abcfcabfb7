"""Retrieval benchmark: labelled cases, references checked, quality of a ranking."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.operators import metrics


#: Ranks from here on are those of expected threads that were not found.
NOT_FOUND = 10_000


class InvalidFixture(ValueError):
    pass


def load_fixture(text: str) -> dict:
    """A fixture whose cases name threads and whose posts name conversations that exist."""
    raw = json.loads(text)
    if raw.get("schemaVersion") != 1:
        raise InvalidFixture("another schema version")
    conversations, ids = {c["id"] for c in raw["conversations"]}, [p["id"] for p in raw["posts"]]
    if len(set(ids)) != len(ids):
        raise InvalidFixture("a post id stands twice")
    roots = {p["id"] for p in raw["posts"] if not p.get("rootId")}
    for p in raw["posts"]:
        if p["conversationId"] not in conversations or (p.get("rootId") and p["rootId"] not in roots):
            raise InvalidFixture(f"post {p['id']} names what is not there")
    names = [c["id"] for c in raw["cases"]]
    if len(set(names)) != len(names):
        raise InvalidFixture("a case id stands twice")
    for c in raw["cases"]:
        if any(t["threadId"] not in roots for t in c["expectedThreads"]):
            raise InvalidFixture(f"case {c['id']} expects a thread that is not there")
    return raw


def fixture_posts(spark: SparkSession, fixture: dict) -> DataFrame:
    rows = [(p["id"], p.get("rootId") or "", p.get("rootId") or p["id"], p["conversationId"], p["userId"], p["createAt"], p["createAt"], 0, p["message"]) for p in fixture["posts"]]
    return spark.createDataFrame(rows, "id string, root_id string, thread_id string, conversation_id string, user_id string, create_at long, update_at long, delete_at long, message string")


def run(spark: SparkSession, fixture: dict, search: Callable[..., DataFrame], k: int = 10, prepare: Callable[[DataFrame], object] = lambda posts: posts) -> DataFrame:
    """(case, recall, rr, ndcg) of a search function on every case; expected threads that are not found have the last rank.

    search takes what prepare makes of the posts (an index, say), a subject and terms.
    """
    source = prepare(fixture_posts(spark, fixture))
    rows = []
    for c in fixture["cases"]:
        found = [r["thread_id"] for r in search(source, c["subject"], c.get("queries", [])).select("thread_id").collect()]
        grades = {t["threadId"]: t["grade"] for t in c["expectedThreads"]}
        rows += [(c["id"], i + 1, grades.pop(t, 0)) for i, t in enumerate(found)]
        rows += [(c["id"], NOT_FOUND + i, g) for i, g in enumerate(grades.values())]
    return metrics.ranking_quality(spark.createDataFrame(rows, "case string, rank int, grade int"), k)


def ranked(index, fixture: dict, most: int = 100) -> DataFrame:
    """(case, rank, thread_id, grade): the threads that a fixture's cases find, all in one plan, and behind them what each expects and does not find."""
    from weft.plans.search import fused_batch

    spark, cases = index.spark, fixture["cases"]
    names = spark.createDataFrame([(i, c["id"]) for i, c in enumerate(cases)], "subject int, case string")
    grades = spark.createDataFrame([(i, t["threadId"], t["grade"]) for i, c in enumerate(cases) for t in c["expectedThreads"]], "subject int, thread_id string, grade int")
    found = fused_batch(index, [(c["subject"], c.get("queries", [])) for c in cases], most).select("subject", "thread_id", F.col("place").alias("rank"))
    both = found.join(grades, ["subject", "thread_id"], "full")
    behind = F.lit(NOT_FOUND) + F.row_number().over(Window.partitionBy("subject", F.col("rank").isNull()).orderBy("thread_id"))
    return both.withColumn("rank", F.coalesce("rank", behind)).join(names, "subject").select("case", "rank", "thread_id", F.coalesce("grade", F.lit(0)).alias("grade"))


def report(rows: DataFrame, posts: DataFrame, users: DataFrame, k: int = 10) -> DataFrame:
    """(case, recall, rr, ndcg, irrelevant, budget_before): quality of ranked rows, threads without a grade in the first k, and the
    characters that stand before the first thread with one (all of them where none is found)."""
    from weft.operators.threads import rendered_units

    size = posts.where("delete_at = 0").join(rendered_units(posts, users), "id").groupBy("thread_id").agg(F.sum("units").alias("units"))
    held = rows.where(F.col("rank") < NOT_FOUND).join(size, "thread_id", "left")
    first = held.groupBy("case").agg(F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first"))
    before = held.join(first, "case").groupBy("case").agg(F.coalesce(F.sum(F.when(F.col("first").isNull() | (F.col("rank") < F.col("first")), F.col("units"))), F.lit(0)).alias("budget_before"), F.count_if((F.col("rank") <= k) & (F.col("grade") == 0)).alias("irrelevant"))
    return metrics.ranking_quality(rows, k).join(before, "case", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("irrelevant", "budget_before")})


def stable(first: DataFrame, second: DataFrame) -> DataFrame:
    """(case, stable): whether two runs found the same threads in the same order."""
    one = lambda df, name: df.groupBy("case").agg(F.array_sort(F.collect_list(F.struct("rank", "thread_id"))).alias(name))
    return one(first, "a").join(one(second, "b"), "case", "full").select("case", F.col("a").eqNullSafe(F.col("b")).alias("stable"))


def means(quality: DataFrame) -> DataFrame:
    return quality.agg(*[F.round(F.avg(c), 6).alias(c) for c in ("recall", "rr", "ndcg")])
