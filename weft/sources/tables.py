"""The engine's relational tables, derived from the driver's tables.

Every mapping is a plain projection (and one pre-aggregated join for a thread's root),
so filters and column selections reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_MS = 1_704_067_200_000
HOUR_MS, MINUTE_MS = 3_600_000, 60_000
#: (alias, priority, scopes, repositories) of the five configured conversations c0 to c4; c4 is not in the index.
ROUTES = [("c0", "payments", 100, ["payments"], ["pay"]), ("c1", "platform", 80, ["platform", "core"], ["api"]), ("c2", "support", 60, ["support"], []), ("c3", "leads", 40, ["leadership"], []), ("c4", "random", 20, [], ["api", "web"])]


def conversations_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def posts(spark: SparkSession, sf_dir: str, marked: bool = True) -> DataFrame:
    """One row for each message. marked: deterministic ticket keys and cues are appended, as the driver's text has none."""
    raw = conversations_raw(spark, sf_dir)
    first = raw.groupBy("conv_id").agg(F.min("turn").alias("first_turn"))
    name = lambda turn: f"concat(lpad(cast(conv_id as string), 10, '0'), '-', lpad(cast({turn} as string), 4, '0'))"
    ticket = "CASE (conv_id + turn) % 5 WHEN 0 THEN concat(' PROJ-', cast(conv_id % 11 as string)) WHEN 1 THEN concat(' see OPS-', cast(conv_id % 7 as string), ' and PROJ-', cast(turn % 3 as string)) ELSE '' END"
    cue = "CASE (conv_id * 3 + turn) % 6 WHEN 0 THEN ' approved.' WHEN 1 THEN ' still unclear?' WHEN 2 THEN ' I propose we wait.' WHEN 3 THEN ' Maybe we keep it on the backend, I think.' WHEN 4 THEN ' ok' ELSE ' To be clear: only for the qa stand, I\\'ll go with that.' END"
    ack = "CASE turn % 2 WHEN 0 THEN '+ thanks' ELSE 'Ok, sounds good.' END"
    text = f"CASE WHEN (conv_id * 5 + turn) % 7 = 4 AND turn > 0 THEN {ack} ELSE concat(coalesce(text, ''), {ticket}, {cue}) END" if marked else "coalesce(text, '')"
    stamped = raw.join(first, "conv_id").selectExpr(
        f"{name('turn')} AS id",
        f"CASE WHEN turn = first_turn THEN '' ELSE {name('first_turn')} END AS root_id",
        f"{name('first_turn')} AS thread_id",
        "concat('c', cast(conv_id % 5 as string)) AS conversation_id",
        "role AS user_id",
        f"{EPOCH_MS} + conv_id * {HOUR_MS} + turn * {MINUTE_MS} AS create_at",
        "CASE WHEN (conv_id * 7 + turn) % 29 = 0 AND turn > 0 THEN 1 ELSE 0 END AS dead",
        f"{text} AS raw_message",
    )
    return stamped.selectExpr(
        "id", "root_id", "thread_id", "conversation_id", "user_id", "create_at", "create_at AS update_at",
        "CASE WHEN dead = 1 THEN create_at + 1 ELSE 0 END AS delete_at",
        "CASE WHEN dead = 1 THEN '' ELSE raw_message END AS message",
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = conversations_raw(spark, sf_dir).select(F.col("role").alias("id")).distinct()
    return roles.selectExpr("id", "id AS username", "initcap(id) AS first_name", "'' AS last_name", "CASE WHEN id = 'user' THEN 'Analyst' ELSE '' END AS position", "0L AS delete_at", "id = 'system' AS is_bot")


def conversations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROUTES, "id string, alias string, priority int, scopes array<string>, repositories array<string>")


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, alias, priority, scopes, repositories, number): every conversation as a channel of its own; its scopes are the roles that speak in it."""
    by = conversations_raw(spark, sf_dir).where("conv_id IS NOT NULL").groupBy(F.col("conv_id").alias("number")).agg(F.array_sort(F.collect_set("role")).alias("scopes"))
    return by.selectExpr(
        "concat('k', lpad(cast(number as string), 10, '0')) AS id", "concat(element_at(array('payments', 'platform', 'support', 'leads', 'random'), cast(number % 5 as int) + 1), '-', cast(number as string)) AS alias",
        "cast(100 - 20 * (number % 5) as int) AS priority", "scopes", "CASE number % 5 WHEN 0 THEN array('pay') WHEN 1 THEN array('api') WHEN 4 THEN array('api', 'web') ELSE cast(array() as array<string>) END AS repositories", "number",
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as attachments; page p hangs on turn 0 of conversation p modulo 100."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr(
        "cast(page_id as string) AS id",
        "concat(lpad(cast(page_id % 100 as string), 10, '0'), '-0000') AS post_id",
        "concat('page', cast(page_id as string), CASE page_id % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.csv' WHEN 2 THEN '.html' ELSE '' END) AS name",
        "cast(length(html) as bigint) AS size",
        "CASE WHEN page_id % 13 = 0 THEN 1L ELSE 0L END AS delete_at",
    )


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versioned updates of 26-character post ids."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "lpad(cast(user_id as string), 26, 'p') AS id", "event_id AS arrival", "unix_millis(cast(ts AS timestamp)) AS update_at",
        "CASE WHEN event_type = 'error' THEN unix_millis(cast(ts AS timestamp)) ELSE 0 END AS delete_at", "event_type AS message", "value", "props",
    )
