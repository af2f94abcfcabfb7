"""Registry of queries over the driver's tables, each with its SQL where SQL can say it, and the tables' SQL twins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weft.plans.search import opened
from weft.sources import tables

NOW_MS = 1_704_500_000_000
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# What tables.posts() derives, in SQL.
POSTS = """
raw0 AS (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS ft FROM conversations),
posts AS (
  SELECT lpad(conv_id::VARCHAR, 10, '0') || '-' || lpad(turn::VARCHAR, 4, '0') AS id,
         CASE WHEN turn = ft THEN '' ELSE lpad(conv_id::VARCHAR, 10, '0') || '-' || lpad(ft::VARCHAR, 4, '0') END AS root_id,
         lpad(conv_id::VARCHAR, 10, '0') || '-' || lpad(ft::VARCHAR, 4, '0') AS thread_id,
         'c' || (conv_id % 5)::VARCHAR AS conversation_id, role AS user_id,
         1704067200000 + conv_id * 3600000 + turn * 60000 AS create_at,
         CASE WHEN (conv_id * 7 + turn) % 29 = 0 AND turn > 0 THEN 1704067200000 + conv_id * 3600000 + turn * 60000 + 1 ELSE 0 END AS delete_at,
         CASE WHEN (conv_id * 7 + turn) % 29 = 0 AND turn > 0 THEN '' WHEN (conv_id * 5 + turn) % 7 = 4 AND turn > 0 THEN CASE turn % 2 WHEN 0 THEN '+ thanks' ELSE 'Ok, sounds good.' END ELSE coalesce(text, '') ||
           CASE (conv_id + turn) % 5 WHEN 0 THEN ' PROJ-' || (conv_id % 11)::VARCHAR WHEN 1 THEN ' see OPS-' || (conv_id % 7)::VARCHAR || ' and PROJ-' || (turn % 3)::VARCHAR ELSE '' END ||
           CASE (conv_id * 3 + turn) % 6 WHEN 0 THEN ' approved.' WHEN 1 THEN ' still unclear?' WHEN 2 THEN ' I propose we wait.' WHEN 3 THEN ' Maybe we keep it on the backend, I think.' WHEN 4 THEN ' ok' ELSE ' To be clear: only for the qa stand, I''ll go with that.' END END AS message
  FROM raw0),
live AS (SELECT * FROM posts WHERE delete_at = 0),
users AS (SELECT DISTINCT role AS id, role AS username, role = 'system' AS is_bot FROM conversations),
files AS (SELECT page_id::VARCHAR AS id, lpad((page_id % 100)::VARCHAR, 10, '0') || '-0000' AS post_id,
  'page' || page_id::VARCHAR || CASE page_id % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.csv' WHEN 2 THEN '.html' ELSE '' END AS name,
  length(html)::BIGINT AS size, CASE WHEN page_id % 13 = 0 THEN 1 ELSE 0 END AS delete_at FROM pages),
conf(id, alias, priority, scopes, repositories) AS (VALUES
  ('c0', 'payments', 100, ['payments'], ['pay']), ('c1', 'platform', 80, ['platform', 'core'], ['api']), ('c2', 'support', 60, ['support'], CAST([] AS VARCHAR[])),
  ('c3', 'leads', 40, ['leadership'], CAST([] AS VARCHAR[])), ('c4', 'random', 20, CAST([] AS VARCHAR[]), ['api', 'web'])),
channels AS (SELECT 'k' || lpad(conv_id::VARCHAR, 10, '0') AS id, ['payments', 'platform', 'support', 'leads', 'random'][conv_id % 5 + 1] || '-' || conv_id::VARCHAR AS alias, (100 - 20 * (conv_id % 5))::INT AS priority, conv_id AS number,
  coalesce(list_sort(list_distinct(list(role) FILTER (role IS NOT NULL))), []) AS scopes, CASE conv_id % 5 WHEN 0 THEN ['pay'] WHEN 1 THEN ['api'] WHEN 4 THEN ['api', 'web'] ELSE CAST([] AS VARCHAR[]) END AS repositories FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
keys AS (SELECT DISTINCT thread_id, id, create_at, upper(unnest(regexp_extract_all(message, '\\b[A-Za-z][A-Za-z0-9]+-[0-9]+\\b'))) AS ticket_key FROM live),
placed AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY create_at, id) AS pos FROM posts),
toks AS (SELECT id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS token FROM (SELECT id, regexp_extract_all(lower(message), '[\\p{L}\\p{N}]+') AS w FROM live))
"""


def query(sql: str | None = None, posts: bool = True):
    """Registers a query under its function's name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"WITH {POSTS}{sql}" if posts else sql
        return f

    return register


def _posts(s, d):
    return tables.posts(s, d)


def _index(s, d):
    """The stored index over the derived posts: built once for a session and folder, in the shared folder if the session names one."""
    return opened(s, d, f"{d}/conversations.parquet", f"{scratch(s)}/index-{uuid.uuid4().hex}", lambda: _posts(s, d))


def held(df: DataFrame) -> DataFrame:
    """Keeps what a query reads several times, and lets go of what the query before kept (which is made again if it is still read)."""
    while _held:
        _held.pop().unpersist()
    _held.append(df.persist())
    return df


def also_held(df: DataFrame) -> DataFrame:
    """As held(), beside what the same query keeps already."""
    _held.append(df.persist())
    return df


def scratch(s) -> str:
    """The folder that driver and executors share; in local mode one of our own, where the session names none."""
    where = s.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not s.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append(f"file://{tempfile.mkdtemp(prefix='weft-')}")
    return _own[0]


_own: list[str] = []
_held: list[DataFrame] = []


def _live(s, d):
    return tables.posts(s, d).where("delete_at = 0")
