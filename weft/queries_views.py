"""Queries over output shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import threads, views
from weft.queries_packets import _Q, _packet
from weft.registry import _live, _posts, query
from weft.sources import tables


@query(r"""SELECT id, thread_id, user_id AS author, strftime(make_timestamp(create_at * 1000), '%Y-%m-%dT%H:%M:%S.') || lpad((create_at % 1000)::VARCHAR, 3, '0') || 'Z' AS at, delete_at <> 0 AS deleted, length(message) > 0 AS said FROM posts""")
def thread_messages(s, d):
    return views.messages(_posts(s, d), tables.users(s, d)).select("id", "thread_id", "author", "at", "deleted", (F.length("text") > 0).alias("said"))


@query("""SELECT p.thread_id, count(*) AS posts, count(*) FILTER (delete_at = 0) AS live, min(create_at) AS from_at, max(create_at) AS to_at, arg_max(id, (create_at, id)) AS last_id, any_value(a.authors) AS authors, coalesce(any_value(f.n), 0)::INT AS n_files, coalesce(any_value(f.ids), '') AS files, greatest(0, coalesce(any_value(f.n), 0) - 2)::INT AS files_omitted FROM posts p
  LEFT JOIN (SELECT thread_id, string_agg(user_id, '|' ORDER BY f) AS authors FROM (SELECT thread_id, user_id, min((create_at, id)) AS f FROM live GROUP BY 1, 2) GROUP BY 1) a USING (thread_id)
  LEFT JOIN (SELECT thread_id, count(*) AS n, string_agg(id, '|' ORDER BY id) FILTER (r <= 2) AS ids FROM (SELECT thread_id, f.id, row_number() OVER (PARTITION BY thread_id ORDER BY f.id) AS r FROM files f JOIN live l ON l.id = f.post_id WHERE f.delete_at = 0) GROUP BY 1) f USING (thread_id) GROUP BY 1""")
def thread_bodies(s, d):
    return views.bodies(_posts(s, d), tables.files(s, d), 2).withColumns({"authors": F.array_join("authors", "|"), "files": F.array_join("files", "|")})


@query("""SELECT thread_id, item::BIGINT AS item, CASE WHEN bool_and(k) THEN 'post' ELSE 'brief_projection' END AS kind, arg_min(id, pos) AS first_id, arg_max(id, pos) AS last_id, count(*) AS posts FROM (
  SELECT *, sum(CASE WHEN k OR coalesce(pk, true) THEN 1 ELSE 0 END) OVER (PARTITION BY thread_id ORDER BY pos) AS item FROM (SELECT *, lag(k) OVER (PARTITION BY thread_id ORDER BY pos) AS pk FROM (SELECT *, message LIKE '%approved%' AS k FROM placed))) GROUP BY 1, 2""")
def brief_timelines(s, d):
    p = _posts(s, d)
    return views.brief_timeline(p, p.where(F.col("message").contains("approved")))


@query(""", h AS (SELECT conversation_id AS request, thread_id, id, (create_at // 60000) % 3 AS probe, -length(message)::DOUBLE AS score, left(message, 12) AS text FROM live WHERE message LIKE '%PROJ-%')
  SELECT * FROM (SELECT request, thread_id, row_number() OVER (PARTITION BY request ORDER BY best, thread_id) AS place, probes, excerpts, greatest(0, n - 2)::INT AS omitted FROM (SELECT request, thread_id, min(score) AS best, string_agg(DISTINCT probe::VARCHAR, '|' ORDER BY probe::VARCHAR) AS probes FROM h GROUP BY 1, 2)
  JOIN (SELECT thread_id, count(*) AS n, string_agg(text, '|' ORDER BY score, id) FILTER (r <= 2) AS excerpts FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY score, id) AS r FROM (SELECT thread_id, text, min(score) AS score, arg_min(id, (score, id)) AS id FROM h GROUP BY 1, 2)) GROUP BY 1) USING (thread_id)) WHERE place <= 40""")
def search_projection(s, d):
    hits = _live(s, d).where(F.col("message").contains("PROJ-")).select(F.col("conversation_id").alias("request"), "thread_id", "id", F.expr("(create_at div 60000) % 3").alias("probe"), (-F.length("message")).cast("double").alias("score"), F.left("message", F.lit(12)).alias("text"))
    return views.search_rows(hits, 40, 2).withColumns({"probes": F.array_join(F.transform("probes", lambda p: p.cast("string")), "|"), "excerpts": F.array_join("excerpts", "|")})


@query("SELECT user_id, count(*) AS post_count FROM live GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2")
def people_limited(s, d):
    return views.people(threads.people_activity(_posts(s, d), tables.users(s, d)), 2.7).select("user_id", "post_count")


@query(f"{_Q} SELECT request, thread_id, row_number() OVER (PARTITION BY request ORDER BY thread_id <> primary_thread, rank, thread_id) AS place FROM sc JOIN pr USING (request)")
def reading_order(s, d):
    from weft.operators import selection

    rows = _packet(s, d)
    return views.reading_order(rows.join(selection.primary_threads(rows), "request"))


@query("SELECT id AS file_id, name, CASE WHEN id::INT % 3 = 0 THEN 'preview' ELSE 'not_inspected' END AS status, 'low' AS trust FROM files WHERE delete_at = 0")
def inspected_attachments(s, d):
    f = tables.files(s, d)
    return views.inspected(f, f.where("cast(id AS int) % 3 = 0").select(F.col("id").alias("file_id"), F.lit("preview").alias("status")))


@query("SELECT alias, CASE number % 7 WHEN 1 THEN 'renamed' WHEN 2 THEN 'other_id' WHEN 3 THEN 'missing' ELSE 'ok' END AS status FROM channels")
def conversation_identities(s, d):
    c = tables.channels(s, d)
    seen = c.where("number % 7 <> 3").selectExpr("CASE number % 7 WHEN 2 THEN concat('x', id) ELSE id END AS id", "CASE number % 7 WHEN 1 THEN concat(alias, '-old') ELSE alias END AS name")
    return views.identities(c.select("alias", "id", F.col("alias").alias("name")), seen)


@query("SELECT 'user' AS kind, 'assistant' AS id WHERE EXISTS (SELECT 1 FROM posts WHERE user_id = 'assistant') UNION ALL SELECT 'file', id FROM files WHERE id::INT % 2 = 1 AND post_id IN (SELECT id FROM posts)")
def unfetched_references(s, d):
    f = tables.files(s, d)
    return views.unfetched(_posts(s, d), tables.users(s, d).where("id <> 'assistant'"), f.select("post_id", "id"), f.where("cast(id AS int) % 2 = 0"))


@query("SELECT thread_id, count(*) FILTER (message LIKE '%approved%') AS returned, count(*) FILTER (message NOT LIKE '%approved%') AS omitted, coalesce(sum(length(message)) FILTER (message LIKE '%approved%'), 0)::BIGINT AS units FROM posts GROUP BY 1")
def packing_totals(s, d):
    return views.packing_totals(_posts(s, d).select("thread_id", F.col("message").contains("approved").alias("selected"), F.length("message").alias("units")))


@query("""SELECT id, CASE WHEN st > 0 THEN '…' ELSE '' END || array_to_string(list_slice(w, st + 1, st + 24), ' ') || CASE WHEN st + 24 < len(w) THEN '…' ELSE '' END AS snippet FROM (
  SELECT id, w, least(greatest(coalesce(list_position(w, 'approved'), 0) - 1 - 8, 0), greatest(len(w) - 24, 0)) AS st FROM (SELECT id, regexp_extract_all(lower(message), '[\\p{L}\\p{N}]+') AS w FROM live))""")
def token_snippets(s, d):
    return _live(s, d).select("id", views.token_snippet(F.col("message"), "approved").alias("snippet"))


_CONCEPTS = {"deferral": ["wait", "we wait"], "placement": ["backend", "keep it on the backend"], "test": ["qa", "qa stand"]}
_ALIASES = ", ".join(f"('{c}', '{a}')" for c, own in _CONCEPTS.items() for a in own)


@query(f"""SELECT message AS value, arg_min(concept, (-length(alias), alias, concept)) AS concept, arg_min(alias, (-length(alias), alias, concept)) AS alias FROM live, (VALUES {_ALIASES}) a(concept, alias)
  WHERE regexp_matches(lower(message), '(^|[^\\p{{L}}\\p{{N}}_])' || alias || '($|[^\\p{{L}}\\p{{N}}_])') GROUP BY id, message""")
def concept_queries(s, d):
    return views.concept_of(_live(s, d).select(F.col("message").alias("value")), _CONCEPTS)
