"""Queries over lookups, predicates and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import text as T
from weft.operators import lookups, threads
from weft.registry import _live, _posts, query
from weft.sources import tables


def _ids(s, values):
    return s.createDataFrame([(v,) for v in values], "id string")


@query("SELECT id, thread_id, user_id, create_at FROM posts WHERE id = '0000000003-0001'")
def post_by_id(s, d):
    return _posts(s, d).where("id = '0000000003-0001'").select("id", "thread_id", "user_id", "create_at")


@query("SELECT id, username, is_bot FROM users WHERE id IN ('user', 'nobody')")
def users_by_ids(s, d):
    return lookups.by_ids(tables.users(s, d), _ids(s, ["user", "nobody"])).select("id", "username", "is_bot")


@query("SELECT id, name, size, delete_at FROM files WHERE id IN ('3', '26', 'x')")
def files_by_ids(s, d):
    return lookups.by_ids(tables.files(s, d), _ids(s, ["3", "26", "x"])).select("id", "name", "size", "delete_at")


@query("SELECT f.id AS file_id, post_id, conversation_id, f.delete_at = 0 AND p.delete_at = 0 AS downloadable FROM files f JOIN posts p ON p.id = post_id")
def file_owners(s, d):
    return lookups.file_owners(tables.files(s, d), _posts(s, d))


@query("SELECT conversation_id, arg_max(id, (create_at, id)) AS newest_post_id, max(create_at) AS newest_post_at FROM posts WHERE conversation_id = 'c2' GROUP BY 1")
def checkpoint_lookup(s, d):
    from weft.operators import writes

    return writes.advance_checkpoints(_posts(s, d)).where("conversation_id = 'c2'").select("conversation_id", "newest_post_id", "newest_post_at")


@query("SELECT a.alias, c.id, CASE WHEN c.id IS NULL THEN 'unknown' WHEN c.id IN (SELECT conversation_id FROM posts WHERE conversation_id <> 'c4') THEN 'ok' ELSE 'unindexed' END AS status FROM (VALUES ('payments'), ('random'), ('ghost')) a(alias) LEFT JOIN conf c ON c.alias = a.alias")
def scope_by_alias(s, d):
    aliases = s.createDataFrame([("payments",), ("random",), ("ghost",)], "alias string")
    return lookups.restrict(tables.conversations(s), _posts(s, d).where("conversation_id <> 'c4'").select(F.col("conversation_id").alias("id")), aliases)


@query("SELECT id FROM posts WHERE conversation_id IN ('c1', 'c3')")
def conversation_scope(s, d):
    return lookups.scoped(_posts(s, d), _ids(s, ["c1", "c3"])).select("id")


@query("SELECT id FROM posts WHERE false")
def empty_scope(s, d):
    return lookups.scoped(_posts(s, d), _ids(s, [])).select("id")


@query("SELECT id, alias, priority FROM conf WHERE id IN (SELECT conversation_id FROM keys JOIN posts USING (id) WHERE ticket_key = 'OPS-3')")
def ticket_narrowing(s, d):
    p = _posts(s, d)
    edges = threads.ticket_conversations(threads.ticket_edges(p), p).where("ticket_key = 'OPS-3'")
    return lookups.narrow_by_ticket(tables.conversations(s).select("id", "alias", "priority"), edges)


_EVENTS = "SELECT user_id, event_id, event_type, value FROM events"


@query(f"SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM ({_EVENTS})) WHERE r = 1", posts=False)
def last_write_wins(s, d):
    return lookups.last_write_wins(s.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id")


@query(f"SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM ({_EVENTS})) WHERE r = 1", posts=False)
def first_write_wins(s, d):
    return lookups.first_write_wins(s.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "event_type", "value"), ["user_id", "event_type"], "event_id")


_PROPS = "CASE substr(id, 9, 2) WHEN '03' THEN '{\"from_webhook\": \"true\"}' WHEN '04' THEN '{\"from_bot\": true}' ELSE '{\"from_bot\": false}' END"


@query(f"""SELECT p.thread_id FROM posts p JOIN users u ON u.id = p.user_id WHERE p.id = p.thread_id AND (is_bot OR substr(p.id, 9, 2) IN ('03', '04')) AND p.thread_id NOT IN (SELECT thread_id FROM live WHERE id <> thread_id AND create_at % 2 = 1)""")
def automation_threads(s, d):
    p = _posts(s, d).withColumn("props", F.expr(_PROPS)).where("id = thread_id OR create_at % 2 = 1")
    return lookups.by_automation(p, tables.users(s, d))


@query("SELECT id, 'https://chat.example/_redirect/pl/' || id AS link FROM posts")
def permalink_build(s, d):
    return _posts(s, d).select("id", lookups.permalink("https://chat.example/", F.col("id")).alias("link"))


@query("SELECT DISTINCT p.user_id, u.username, upper(u.username[1:1]) || u.username[2:] AS display_name, CASE u.username WHEN 'user' THEN 'Analyst' WHEN 'assistant' THEN 'Writer' END AS role, CASE u.username WHEN 'user' THEN 'profile' WHEN 'assistant' THEN 'config' END AS role_source, is_bot FROM posts p JOIN users u ON u.id = user_id")
def people_roster(s, d):
    return lookups.roster(_posts(s, d), tables.users(s, d), {"user": "Reader", "assistant": "Writer"})


@query("SELECT thread_id, bool_or(id = thread_id) AS root_present, count(DISTINCT conversation_id) = 1 AS one_conversation, bool_and(id = thread_id OR root_id = thread_id) AS one_root, bool_or(id = thread_id) AND count(DISTINCT conversation_id) = 1 AND bool_and(id = thread_id OR root_id = thread_id) AS ok FROM posts GROUP BY 1")
def thread_boundary(s, d):
    return lookups.boundary(_posts(s, d))


@query("""SELECT id, delete_at = 0 AND NOT regexp_matches(message, '\\S') AND f AS media_only, contains(message, '```') AS fenced, f OR contains(message, '```') OR k >= 2 OR length(message) >= 400 AS structural, f OR contains(message, '```') AS file_or_fence, f OR contains(message, '```') OR k >= 2 AS structural_short
  FROM (SELECT p.*, id IN (SELECT post_id FROM files WHERE delete_at = 0) AS f, (SELECT count(DISTINCT ticket_key) FROM keys WHERE keys.id = p.id) AS k FROM posts p)""")
def post_shapes(s, d):
    return lookups.post_shapes(_posts(s, d), tables.files(s, d))


_ERRORS = " OR ".join(f"contains(replace(lower(message), 'ё', 'е'), '{c}')" for c in lookups.ERROR_CUES)


@query(f"""SELECT thread_id, id, kind FROM (SELECT thread_id, id, CASE WHEN regexp_matches(message, '\\?\\s*$') THEN 'question' WHEN {_ERRORS} THEN 'error' END AS kind, row_number() OVER (PARTITION BY thread_id ORDER BY create_at DESC, id DESC) AS r, delete_at FROM posts) WHERE r = 1 AND delete_at = 0 AND kind IS NOT NULL""")
def thread_tails(s, d):
    return lookups.tails(_posts(s, d))


_HAS = r"regexp_matches(lower(message), '(^|[^\p{{L}}\p{{N}}_]){0}($|[^\p{{L}}\p{{N}}_])')"


@query(f"""SELECT thread_id, id FROM (SELECT *, bool_or(a) OVER (PARTITION BY thread_id) AND bool_or(b) OVER (PARTITION BY thread_id) AND (a OR b) OR c AS hit FROM (SELECT *, {_HAS.format('approved')} AS a, {_HAS.format('unclear')} AS b, {_HAS.format('qa stand')} AS c FROM live)) WHERE hit""")
def current_matches(s, d):
    return lookups.current_matches(_posts(s, d), [("approved unclear", ["approved", "unclear"]), ("qa stand", [])])


@query(f"""SELECT thread_id, array_to_string(list_filter(['approved', 'ghostword', 'unclear'], lambda x: x = 'approved' AND a OR x = 'unclear' AND b), '|') AS covered, array_to_string(list_filter(['approved', 'ghostword', 'unclear'], lambda x: NOT (x = 'approved' AND a OR x = 'unclear' AND b)), '|') AS missing
  FROM (SELECT thread_id, bool_or({_HAS.format('approved')}) AS a, bool_or({_HAS.format('unclear')}) AS b FROM live GROUP BY 1)""")
def term_coverage(s, d):
    out = lookups.uncovered_terms(_posts(s, d), ["approved", "unclear", "ghostword"])
    return out.select("thread_id", F.array_join("covered", "|").alias("covered"), F.array_join("missing", "|").alias("missing"))


@query(""", m AS (SELECT conversation_id AS request, ticket_key AS key, id, (substr(thread_id, 10, 1)::INT) AS thread_rank, create_at % 120000 = 0 AS in_window, contains(message, 'see OPS') AS bulletin, create_at FROM keys JOIN live USING (thread_id, id, create_at) WHERE ticket_key <> 'PROJ-1'),
  r AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY bulletin_only, best_rank <> 0, best_rank, in_window DESC, mentions DESC, latest_at DESC, key) AS place FROM (SELECT request, key, count(*) AS mentions, count(*) FILTER (in_window) AS in_window, bool_and(bulletin) AS bulletin_only, min(thread_rank) AS best_rank, max(create_at) AS latest_at,
    arg_min(id, (bulletin, thread_rank, NOT in_window, create_at, id)) AS first_id FROM m GROUP BY 1, 2))
  SELECT *, CASE WHEN count(*) FILTER (NOT bulletin_only) OVER (PARTITION BY request) >= 2 THEN NOT bulletin_only ELSE true END AND place <= 3 AS hop FROM r""")
def related_ticket_ranking(s, d):
    keys = _live(s, d).withColumn("key", F.explode(T.ticket_keys(F.col("message")))).where("key <> 'PROJ-1'")
    rows = keys.select(F.col("conversation_id").alias("request"), "key", "id", F.expr("cast(substr(thread_id, 10, 1) AS int)").alias("thread_rank"), (F.col("create_at") % 120_000 == 0).alias("in_window"), F.col("message").contains("see OPS").alias("bulletin"), "create_at")
    return lookups.ranked_ticket_keys(rows)


@query("""SELECT id, 'https://jira.example.org/browse/PROJ-' || substr(id, 10, 1) AS url FROM posts WHERE substr(id, 10, 1) <> '0'""")
def tracker_urls(s, d):
    p = _posts(s, d).withColumn("x", F.expr("concat('see https://x.org/PROJ-', substr(id, 10, 1), ' and https://jira.example.org/browse/PROJ-', substr(id, 10, 1), ').')"))
    return p.select("id", lookups.tracker_url(F.col("x"), F.expr("concat('PROJ-', substr(id, 10, 1))")).alias("url")).where("substr(id, 10, 1) <> '0'")


@query("SELECT id, greatest(0, least(50, length(message) // 10, greatest(1, 2000 // greatest(1, length(message))) - 1))::BIGINT AS side FROM posts")
def around_sides(s, d):
    return _posts(s, d).select("id", lookups.around_sides((F.length("message") / 10), F.lit(2000), F.length("message")).alias("side"))


_WORDS = "list_distinct(list_filter(regexp_extract_all(lower(regexp_replace(regexp_replace(message, 'https?://[^\\s<>()]+', ' ', 'gi'), 'PROJ-1', ' ', 'gi')), '[\\p{L}\\p{N}]+'), lambda t: length(t) > 2 AND t NOT IN (" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")))"


@query(f"""SELECT thread_id, prior_id, CASE WHEN bool_or(names OR len(list_intersect(own, ws)) > 0) OVER (PARTITION BY thread_id) OR len(own) < 2 THEN 'possible' ELSE 'low' END AS relevance FROM (
  SELECT r.id AS thread_id, r.prior_id, a.w AS own, b.w AS ws, r.prior_id IN (SELECT id FROM keys WHERE ticket_key = 'PROJ-1') AS names FROM (SELECT id, unnest(l) AS prior_id FROM (SELECT id, [lag(id, 1) OVER w, lag(id, 2) OVER w] AS l FROM live WHERE root_id = '' WINDOW w AS (PARTITION BY conversation_id ORDER BY create_at, id))) r
  JOIN (SELECT id, {_WORDS} AS w FROM posts) a ON a.id = r.id JOIN (SELECT id, {_WORDS} AS w FROM posts) b ON b.id = r.prior_id WHERE r.prior_id IS NOT NULL AND r.id IN (SELECT thread_id FROM live GROUP BY 1 HAVING count(*) - 1 <= 3))""")
def surround_relevance(s, d):
    p = _posts(s, d)
    return lookups.surround(p, threads.preceding_roots(p, 2), "PROJ-1")
