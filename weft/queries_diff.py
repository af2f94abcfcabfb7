"""Packets of all threads before and after the last of their posts came, compared in every mode."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import text as T
from weft.operators import packet_diff
from weft.registry import _posts, query

_SIDE = """SELECT thread_id, count(*) AS n, list(id ORDER BY create_at, id) AS ids, list(user_id ORDER BY create_at, id) AS authors, list(create_at ORDER BY create_at, id) AS ats, list(left(message, 40) ORDER BY create_at, id) AS texts,
  list(contains(message, 'approved') ORDER BY create_at, id) AS signals FROM {source} GROUP BY thread_id"""
_LEAVES = """SELECT thread_id, 'total_posts' AS path, n::VARCHAR AS value FROM {side} UNION ALL SELECT thread_id, 'observed_at', '<masked>' FROM {side}
  UNION ALL SELECT thread_id, unnest(list_transform(range(n), lambda i: 'posts[' || i || '].id')), unnest(ids) FROM {side} UNION ALL SELECT thread_id, unnest(list_transform(range(n), lambda i: 'posts[' || i || '].author')), unnest(authors) FROM {side}
  UNION ALL SELECT thread_id, unnest(list_transform(range(n), lambda i: 'posts[' || i || '].create_at')), unnest(ats)::VARCHAR FROM {side} UNION ALL SELECT thread_id, unnest(list_transform(range(n), lambda i: 'posts[' || i || '].excerpt')), unnest(texts) FROM {side}
  UNION ALL SELECT thread_id, unnest(list_transform(range(n), lambda i: 'posts[' || i || '].signals.approved')), unnest(signals)::VARCHAR FROM {side}
  UNION ALL SELECT thread_id, 'tickets.' || ticket_key, count(*)::VARCHAR FROM keys WHERE (thread_id, id) IN (SELECT thread_id, id FROM {source}) GROUP BY 1, 2"""
_DIFF = f""", tops AS (SELECT thread_id, max(create_at) AS top FROM live GROUP BY 1), early AS (SELECT live.* FROM live JOIN tops USING (thread_id) WHERE create_at < top),
b0 AS ({_SIDE.format(source='early')}), a0 AS ({_SIDE.format(source='live')}), b AS ({_LEAVES.format(side='b0', source='early')}), a AS ({_LEAVES.format(side='a0', source='live')}),
df AS (SELECT coalesce(a.thread_id, b.thread_id) AS thread_id, coalesce(a.path, b.path) AS path, b.value AS before, a.value AS after, CASE WHEN a.path IS NULL THEN 'removed' WHEN b.path IS NULL THEN 'added' ELSE 'changed' END AS change
  FROM a FULL JOIN b ON a.thread_id = b.thread_id AND a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.value <> b.value)"""


def _packets(posts, observed_at: int):
    """A nested packet for each thread."""
    post = F.struct("create_at", "id", F.col("user_id").alias("author"), F.left("message", F.lit(40)).alias("excerpt"), F.struct(F.col("message").contains("approved").alias("approved")).alias("signals"))
    by = posts.groupBy("thread_id").agg(F.count(F.lit(1)).alias("total_posts"), F.array_sort(F.collect_list(post)).alias("posts"))
    named = posts.select("thread_id", F.explode(F.array_distinct(T.ticket_keys(F.col("message")))).alias("k")).groupBy("thread_id", "k").agg(F.count(F.lit(1)).alias("n"))
    tickets = named.groupBy("thread_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("tickets"))
    return by.join(tickets, "thread_id", "left").select("thread_id", "total_posts", F.lit(observed_at).alias("observed_at"), "posts", F.coalesce("tickets", F.expr("cast(map() AS map<string, bigint>)")).alias("tickets"))


def _changes(s, d):
    live = _posts(s, d).where("delete_at = 0")
    last = live.groupBy("thread_id").agg(F.max("create_at").alias("at"))
    early = live.join(last, "thread_id").where("create_at < at").drop("at")
    return packet_diff.differences(_packets(early, 1), _packets(live, 2), ["thread_id"])


@query(f"{_DIFF} SELECT * FROM df")
def packet_differences(s, d):
    return _changes(s, d)


_MODES = ", ".join(f"('{m}', '{p}')" for m, p in packet_diff.MODES.items() if m != "json")


@query(f"""{_DIFF} SELECT thread_id, mode, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'changed') AS changed FROM (
  SELECT df.*, mode FROM df, (VALUES {_MODES}) m(mode, shown) WHERE regexp_matches(path, shown) UNION ALL SELECT *, 'json' FROM df WHERE NOT contains(path, '.signals')) GROUP BY 1, 2""")
def packet_diff_modes(s, d):
    return packet_diff.by_mode(_changes(s, d), ["thread_id"])
