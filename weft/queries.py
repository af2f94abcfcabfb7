"""Registered queries over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import text as T
from weft.operators import metrics, ranking, retrieval, routing, sequences, threads, writes
from weft.registry import NOW_MS, QUERIES, SQL, _live, _posts, query
from weft.sources import tables

# --- lookups, joins, filters ----------------------------------------------------------


@query("SELECT id, user_id, create_at, delete_at, message FROM posts WHERE thread_id = '0000000007-0000'")
def thread_posts(s, d):
    return threads.thread_posts(_posts(s, d), "0000000007-0000").select("id", "user_id", "create_at", "delete_at", "message")


@query("SELECT id, alias, priority FROM channels")
def conversations_by_alias(s, d):
    return tables.channels(s, d).select("id", "alias", "priority").orderBy("alias")


@query("SELECT c.id, alias, priority FROM conf c WHERE c.id IN (SELECT conversation_id FROM posts)")
def allowlist_scan(s, d):
    return threads.allowlist(tables.conversations(s), _posts(s, d).select(F.col("conversation_id").alias("id")))


@query("SELECT user_id, username, count(*) AS post_count, max(create_at) AS last_post_at FROM live JOIN users u ON u.id = user_id GROUP BY ALL")
def people_activity(s, d):
    return threads.people_activity(_posts(s, d), tables.users(s, d))


@query("SELECT thread_id, count(*) FILTER (delete_at = 0 AND id <> thread_id) AS replies FROM posts GROUP BY 1")
def thread_reply_counts(s, d):
    return threads.reply_counts(_posts(s, d))


@query("SELECT ticket_key, thread_id, min(id) AS source_post_id FROM keys GROUP BY 1, 2")
def ticket_edges(s, d):
    return threads.ticket_edges(_posts(s, d))


@query("SELECT DISTINCT ticket_key, conversation_id FROM keys JOIN posts USING (thread_id)")
def ticket_conversations(s, d):
    return threads.ticket_conversations(threads.ticket_edges(_posts(s, d)), _posts(s, d))


@query("SELECT DISTINCT thread_id FROM live WHERE lower(user_id) = 'assistant' AND create_at >= 1704100000000 AND create_at < 1704300000000")
def thread_filter_user_date(s, d):
    return threads.filter_threads(_posts(s, d), "@assistant", 1_704_100_000_000, 1_704_300_000_000)


@query("SELECT DISTINCT thread_id FROM live WHERE id IN (SELECT post_id FROM files WHERE delete_at = 0 AND lower(name) LIKE '%.csv%')")
def thread_filter_file(s, d):
    return threads.filter_threads_by_file(_posts(s, d), tables.files(s, d), ".CSV")


@query("""SELECT DISTINCT thread_id FROM posts WHERE thread_id NOT IN (
  SELECT thread_id FROM posts WHERE root_id = '' AND user_id IN (SELECT id FROM users WHERE is_bot)
  AND thread_id IN (SELECT thread_id FROM posts GROUP BY 1 HAVING count(*) FILTER (delete_at = 0 AND id <> thread_id) = 0))""")
def automation_suppression(s, d):
    return threads.without_automation(_posts(s, d), tables.users(s, d))


@query("""SELECT id, b::INT AS back, CASE b WHEN 1 THEN l1 WHEN 2 THEN l2 ELSE l3 END AS prior_id FROM (
  SELECT id, lag(id, 1) OVER w AS l1, lag(id, 2) OVER w AS l2, lag(id, 3) OVER w AS l3 FROM live WHERE root_id = ''
  WINDOW w AS (PARTITION BY conversation_id ORDER BY create_at, id)), unnest([1, 2, 3]) AS t(b)
  WHERE CASE b WHEN 1 THEN l1 WHEN 2 THEN l2 ELSE l3 END IS NOT NULL""")
def preceding_roots_top_k(s, d):
    return threads.preceding_roots(_posts(s, d), 3)


@query("""SELECT p.id, coalesce(username, 'unknown:' || user_id) AS author, coalesce(n, 0)::BIGINT AS n_files, coalesce(b, 0)::BIGINT AS file_bytes, f AS first_file
  FROM posts p LEFT JOIN users u ON u.id = user_id LEFT JOIN (SELECT post_id, count(*) AS n, sum(size) AS b, min(name) AS f FROM files WHERE delete_at = 0 GROUP BY 1) h ON h.post_id = p.id""")
def hydrate_posts(s, d):
    return threads.hydrate(_posts(s, d), tables.users(s, d), tables.files(s, d))


@query("SELECT count(*) AS posts, count(*) FILTER (delete_at <> 0) AS tombstones, count(DISTINCT thread_id) AS threads, (SELECT count(*) FROM files) AS files FROM posts")
def index_statistics(s, d):
    return threads.statistics(_posts(s, d), tables.files(s, d))


@query("SELECT p.id, (length(user_id) + 24 + length(message))::BIGINT AS units FROM posts p")
def rendered_units(s, d):
    return threads.rendered_units(_posts(s, d), tables.users(s, d))


@query("""SELECT ticket_key, count(*) AS mentions, count(DISTINCT thread_id) AS threads, min(create_at) AS first_at, arg_min(id, (create_at, id)) AS first_post
  FROM keys WHERE thread_id IN (SELECT thread_id FROM keys WHERE ticket_key = 'PROJ-1') AND ticket_key <> 'PROJ-1' GROUP BY 1""")
def related_tickets(s, d):
    return threads.related_tickets(_posts(s, d), "PROJ-1")


# --- writes and sync ------------------------------------------------------------------

_EVENTS = "SELECT lpad(user_id::VARCHAR, 26, 'p') AS id, event_id AS arrival, epoch_us(ts) // 1000 AS update_at, CASE WHEN event_type = 'error' THEN epoch_us(ts) // 1000 ELSE 0 END AS delete_at, event_type AS message, value FROM events"


@query(f"SELECT id, arrival, update_at, delete_at, message FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY greatest(update_at, delete_at) DESC, arrival DESC) AS r FROM ({_EVENTS})) WHERE r = 1", posts=False)
def versioned_upsert(s, d):
    return writes.versioned_upsert(tables.updates(s, d)).select("id", "arrival", "update_at", "delete_at", "message")


@query(f"SELECT id, arrival, CASE WHEN delete_at <> 0 THEN '' ELSE message END AS message FROM ({_EVENTS})", posts=False)
def tombstones(s, d):
    return writes.tombstones(tables.updates(s, d)).select("id", "arrival", "message")


@query("SELECT id, conversation_id FROM posts WHERE conversation_id <> 'c1' OR id IN (SELECT id FROM live)")
def full_sync_anti(s, d):
    p = _posts(s, d)
    return writes.finalize_full_sync(p, p.where("delete_at = 0"), "c1").select("id", "conversation_id")


@query("SELECT conversation_id, arg_max(id, (create_at, id)) AS newest_post_id, max(create_at) AS newest_post_at, min(create_at) AS oldest_covered_at FROM posts GROUP BY 1")
def checkpoint_advance(s, d):
    return writes.advance_checkpoints(_posts(s, d))


@query(f"SELECT conversation_id, a AS age_seconds, a > 300 AS stale FROM (SELECT conversation_id, greatest(0, floor(({NOW_MS} - max(create_at)) / 1000))::BIGINT AS a FROM posts GROUP BY 1)")
def freshness(s, d):
    return writes.freshness(writes.advance_checkpoints(_posts(s, d)), NOW_MS)


@query("""SELECT id, post_id, place, through, CASE WHEN place > 2 THEN 'too_many' WHEN through > 12000 THEN 'over_budget' ELSE 'download' END AS status FROM (
  SELECT id, post_id, row_number() OVER w AS place, (sum(size) OVER w)::BIGINT AS through FROM files WHERE delete_at = 0 WINDOW w AS (PARTITION BY post_id ORDER BY id))""")
def batch_download_plan(s, d):
    return writes.download_plan(tables.files(s, d), 2, 12_000)


@query()
def entity_index(s, d):
    return writes.entity_rows(_posts(s, d), tables.files(s, d))


# --- text -----------------------------------------------------------------------------


@query("SELECT id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(message, '\\b[A-Za-z][A-Za-z0-9]+-[0-9]+\\b'), lambda k: upper(k)))), ',') AS ticket_keys FROM posts")
def ticket_keys(s, d):
    return _posts(s, d).select("id", F.array_join(T.ticket_keys(F.col("message")), ",").alias("ticket_keys"))


_MASKED = r"regexp_replace(text, '(?i)https?://[^\s<>()]+', ' ', 'g')"


@query(rf"""SELECT doc_id, kind, count(DISTINCT lower(trim(v))) AS n, min(lower(trim(v))) AS first_value FROM (
  SELECT doc_id, 'commit' AS kind, unnest(regexp_extract_all(text, '(?i)\b[0-9a-f]{{7,40}}\b')) AS v FROM documents
  UNION ALL SELECT doc_id, 'error_code', unnest(regexp_extract_all(text, '\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b')) FROM documents
  UNION ALL SELECT doc_id, 'symbol', unnest(regexp_extract_all(text, '`([A-Za-z_$][A-Za-z0-9_$.]{{2,}})`', 1)) FROM documents
  UNION ALL SELECT doc_id, 'symbol', unnest(regexp_extract_all(text, '\b([A-Za-z_$][A-Za-z0-9_$]{{2,}})\s*\(', 1)) FROM documents
  UNION ALL SELECT doc_id, 'url', regexp_replace(unnest(regexp_extract_all(text, '(?i)https?://[^\s<>()]+')), '[.,;:!?\])}}]+$', '') FROM documents
  UNION ALL SELECT doc_id, 'pull_request', unnest(regexp_extract_all(text, '(?i)\b(?:PR|MR)\s*[#!][0-9]{{1,7}}\b')) FROM documents
  UNION ALL SELECT doc_id, 'username', unnest(regexp_extract_all(text, '(?:^|\s)@([A-Za-z0-9._-]{{2,64}})\b', 1)) FROM documents
  UNION ALL SELECT doc_id, 'file_path', unnest(regexp_extract_all(text, '(?i)(?:^|[\s("''`])((?:[A-Za-z0-9_.-]+/)*[A-Za-z0-9_.-]+\.(?:[cm]?[jt]sx?|py|go|rs|java|kt|rb|php|cs|cpp|h|hpp|sql|ya?ml|json|toml|ini|conf|md))\b', 1)) FROM documents
  UNION ALL SELECT doc_id, 'repository', unnest(regexp_extract_all(text, '(?i)(?:^|[\s(])(?:repo(?:sitory)?|репозитор(?:ий|ия))\s*[:=]?\s*([A-Za-z0-9][A-Za-z0-9_./-]{{1,100}})', 1)) FROM documents
  UNION ALL SELECT doc_id, 'service', unnest(regexp_extract_all(text, '(?i)(?:^|[\s(])(?:service|сервис)\s*[:=]?\s*([A-Za-z0-9][A-Za-z0-9_./-]{{1,100}})', 1)) FROM documents
  UNION ALL SELECT doc_id, 'package', unnest(regexp_extract_all(text, '(?:^|\s)(@[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)(?:$|\s|[),.;:])', 1)) FROM documents
  UNION ALL SELECT doc_id, 'ticket', unnest(regexp_extract_all({_MASKED}, '\b[A-Za-z][A-Za-z0-9]+-[0-9]+\b')) FROM documents) GROUP BY 1, 2""", posts=False)
def entities_extract(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.explode(T.entities(F.coalesce("text", F.lit("")))).alias("e"))
    rows = docs.select("doc_id", F.col("e.kind").alias("kind"), F.lower(F.trim("e.value")).alias("v"))
    return rows.groupBy("doc_id", "kind").agg(F.count_distinct("v").alias("n"), F.min("v").alias("first_value"))


@query(r"""SELECT doc_id, CASE WHEN length(r) > 240 THEN left(r, 239) || '…' ELSE r END AS excerpt FROM (SELECT doc_id,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(password|passwd|пароль|pass)\s*[:=]\s*\S+', '\1: [REDACTED]', 'gi'),
  '(login|логин|username|user|email)\s*[:=]\s*\S+', '\1: [REDACTED]', 'gi'), '(token|api[_-]?key|secret|bearer)\s*[:=]\s*\S+', '\1: [REDACTED]', 'gi'),
  '\b(Bearer)\s+[A-Za-z0-9._\-+=/]{8,}', '\1 [REDACTED]', 'g') AS r FROM documents)""", posts=False)
def redact_excerpt(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


@query(r"SELECT id, len(list_filter(regexp_extract_all(message, '[^.!?\n]*[.!?\n]|[^.!?\n]+$'), lambda x: regexp_matches(x, '[.!?\n]$') OR trim(x) <> '')) ::BIGINT AS n FROM posts")
def sentence_counts(s, d):
    return _posts(s, d).select("id", F.size(T.sentences(F.col("message"))).cast("long").alias("n"))


@query("SELECT alias, 'zzconcept' || lower(hex(encode(alias))) AS token FROM channels")
def concept_tokens(s, d):
    return tables.channels(s, d).select("alias", T.concept_token(F.col("alias")).alias("token"))


@query("SELECT id, strftime(make_timestamp(create_at * 1000), '%Y-%m-%dT%H:%M:%S.') || lpad((create_at % 1000)::VARCHAR, 3, '0') || 'Z' AS at FROM posts")
def iso_timestamps(s, d):
    return _posts(s, d).select("id", T.iso_time(F.col("create_at")).alias("at"))


@query("SELECT id, name, CASE WHEN name LIKE '%.png' THEN 'image' WHEN name LIKE '%.csv' THEN 'data' ELSE 'other' END AS kind FROM files")
def file_kinds(s, d):
    return tables.files(s, d).select("id", "name", T.file_kind(F.col("name")).alias("kind"))


@query("""SELECT id, CASE WHEN length(message) <= 240 THEN message WHEN position('approved' IN lower(message)) = 0 THEN left(message, 240)
  ELSE substring(message, greatest(position('approved' IN lower(message)) - 100, 1), 208) END AS snippet FROM posts""")
def match_snippet(s, d):
    return _posts(s, d).select("id", T.snippet(F.col("message"), "approved").alias("snippet"))


@query("""SELECT id, CASE WHEN regexp_matches(message, '["\\r\\n,]') THEN '"' || replace(message, '"', '""') || '"' ELSE message END AS field FROM posts""")
def csv_encode(s, d):
    return _posts(s, d).select("id", T.csv_field(F.col("message")).alias("field"))


@query("SELECT probe, arg_min(alias, (levenshtein(alias, probe), alias)) AS suggestion FROM channels, (VALUES ('paymets-10'), ('platfrm-6'), ('suport-2')) p(probe) GROUP BY 1")
def alias_suggestion(s, d):
    probes = s.createDataFrame([("paymets-10",), ("platfrm-6",), ("suport-2",)], "probe string")
    near = tables.channels(s, d).crossJoin(F.broadcast(probes)).select("probe", "alias", F.levenshtein("alias", "probe").alias("edits"))
    return near.groupBy("probe").agg(F.min_by("alias", F.struct("edits", "alias")).alias("suggestion"))


# --- retrieval ------------------------------------------------------------------------


def _bm25_sql(terms: list[str], all_terms: bool = False) -> str:
    inside = ", ".join(f"'{t}'" for t in terms)
    return f"""SELECT id, round(-sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_len))), 6) AS bm25 FROM (
      SELECT id, token, count(*)::DOUBLE AS tf FROM toks WHERE token IN ({inside}) GROUP BY 1, 2)
      JOIN (SELECT token, CASE WHEN x <= 0 THEN 1e-6 ELSE x END AS idf FROM (SELECT token, ln(((SELECT count(*) FROM live) - count(DISTINCT id) + 0.5) / (count(DISTINCT id) + 0.5)) AS x FROM toks WHERE token IN ({inside}) GROUP BY 1)) USING (token)
      JOIN (SELECT id, len(regexp_extract_all(lower(message), '[\\p{{L}}\\p{{N}}]+')) AS n, avg(len(regexp_extract_all(lower(message), '[\\p{{L}}\\p{{N}}]+'))) OVER () AS avg_len FROM live) USING (id)
      GROUP BY id {f'HAVING count(*) = {len(terms)}' if all_terms else ''}"""


@query(_bm25_sql(["proj"]))
def bm25_term(s, d):
    return retrieval.bm25(_live(s, d), ["proj"]).withColumn("bm25", F.round("bm25", 6))


@query(_bm25_sql(["approved", "ops", "the"], True))
def bm25_strict(s, d):
    return retrieval.bm25(_live(s, d), ["approved", "ops", "the"], mode="all").withColumn("bm25", F.round("bm25", 6))


@query(_bm25_sql(["approved", "ops", "unclear"]))
def bm25_broad(s, d):
    return retrieval.bm25(_live(s, d), ["approved", "ops", "unclear"]).withColumn("bm25", F.round("bm25", 6))


@query("SELECT a.id, count(*) AS n FROM toks a JOIN toks b ON a.id = b.id AND b.pos = a.pos + 1 WHERE a.token = 'still' AND b.token = 'unclear' GROUP BY 1")
def phrase_match(s, d):
    return retrieval.phrase(_live(s, d), ["still", "unclear"])


@query("SELECT id, count(DISTINCT token) AS n FROM toks WHERE starts_with(token, 'appr') GROUP BY 1")
def prefix_match(s, d):
    return retrieval.prefix(_live(s, d), "appr")


@query("""SELECT id, round(max(sim), 6) AS similarity FROM (SELECT id, 2.0 * len(list_intersect(g, ['apr', 'pro', 'rov', 'ove', 'ved'])) / (len(g) + 5) AS sim FROM (
  SELECT DISTINCT id, token, list_distinct(list_transform(range(1, length(token) - 1), lambda i: token[i:i + 2])) AS g FROM toks WHERE length(token) >= 3 AND levenshtein(token, 'aproved') <= 2)) GROUP BY 1 HAVING max(sim) >= 0.5""")
def trigram_match(s, d):
    return retrieval.typo(_live(s, d), "aproved").withColumn("similarity", F.round("similarity", 6))


@query("SELECT DISTINCT id AS post_id, 'username' AS kind, user_id AS value FROM live WHERE user_id = 'assistant'")
def entity_search(s, d):
    return retrieval.entity_search(writes.entity_rows(_posts(s, d), tables.files(s, d)), "username", "Assistant")


_HITS = """h AS (SELECT id, thread_id, 'exact_phrase' AS source, 0 AS probe FROM live WHERE message LIKE '%PROJ-1' OR message LIKE '%PROJ-1 %'
  UNION ALL SELECT id, thread_id, 'term_fts', 1 FROM live WHERE message LIKE '%approved%' UNION ALL SELECT id, thread_id, 'term_fts', 0 FROM live WHERE message LIKE '%OPS-2%')"""


def _hits(s, d):
    p = _live(s, d)
    has = lambda x: F.col("message").contains(x)
    one = p.where(F.col("message").endswith("PROJ-1") | has("PROJ-1 ")).withColumns({"source": F.lit("exact_phrase"), "probe": F.lit(0)})
    two = p.where(has("approved")).withColumns({"source": F.lit("term_fts"), "probe": F.lit(1)})
    return one.unionByName(two).unionByName(p.where(has("OPS-2")).withColumns({"source": F.lit("term_fts"), "probe": F.lit(0)})).select("id", "thread_id", "source", "probe")


@query(f""", {_HITS} SELECT thread_id, round(sum(w / (60 + rank)), 9) AS fusion FROM (
  SELECT thread_id, CASE source WHEN 'exact_phrase' THEN 1.0 ELSE 0.75 END AS w, row_number() OVER (PARTITION BY probe, source ORDER BY min(id)) AS rank FROM h GROUP BY thread_id, probe, source) GROUP BY 1""")
def rrf_fusion(s, d):
    from pyspark.sql import Window

    first = _hits(s, d).groupBy("thread_id", "probe", "source").agg(F.min("id").alias("first"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("probe", "source").orderBy("first")))
    return retrieval.fuse(ranked).withColumn("fusion", F.round("fusion", 9))


@query(f""", {_HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY probe, source ORDER BY id) AS rank FROM h)
  SELECT id, probe, arg_min(source, (CASE source WHEN 'exact_phrase' THEN 0 ELSE 1 END, rank, source)) AS source, arg_min(rank, (CASE source WHEN 'exact_phrase' THEN 0 ELSE 1 END, rank, source)) AS rank, count(*) AS evidence FROM r GROUP BY id, probe""")
def match_dedupe(s, d):
    from pyspark.sql import Window

    ranked = _hits(s, d).withColumn("rank", F.row_number().over(Window.partitionBy("probe", "source").orderBy("id")).cast("long"))
    return retrieval.dedupe_matches(ranked)


# --- routing --------------------------------------------------------------------------


@query("SELECT id, alias, priority, 'repositories' AS evidence, 4 AS weight FROM channels WHERE list_contains(repositories, 'api')")
def route_cascade(s, d):
    return routing.route(tables.channels(s, d), scopes=["nowhere"], repositories=["api"])


@query("SELECT id, alias, priority, 'widened' AS evidence, 2 AS weight FROM channels WHERE NOT list_contains(repositories, 'api')")
def route_widen(s, d):
    c = tables.channels(s, d)
    return routing.widen(c, routing.route(c, repositories=["api"]))


@query("SELECT h AS hint FROM (VALUES ('assistant'), ('ghost'), ('spirit')) t(h) WHERE h NOT IN (SELECT unnest(scopes) FROM channels)")
def unmatched_hints(s, d):
    return routing.unmatched(tables.channels(s, d), "scopes", ["assistant", "ghost", "spirit"])


# --- sequences ------------------------------------------------------------------------


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS tm FROM events),
  c AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY tm RANGE BETWEEN CURRENT ROW AND 3600000 FOLLOWING) AS n, count(*) OVER (PARTITION BY user_id) AS total FROM e)
  SELECT user_id, n, tm AS start_at, event_id AS first_id, total FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, tm, event_id) AS r FROM c) WHERE r = 1 AND n >= 3 AND n < total""", posts=False)
def densest_hour(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    return sequences.densest_window(e, "user_id", "at", "event_id")


_COVERED = ", cov AS (SELECT *, max(hit) OVER (PARTITION BY thread_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS cov FROM (SELECT *, CASE WHEN message LIKE '%OPS-%' THEN 1 ELSE 0 END AS hit FROM placed))"


def _covered(s, d):
    return sequences.covered(_posts(s, d), F.col("message").contains("OPS-"), 1)


@query(f"""{_COVERED}, i AS (SELECT *, sum(new) OVER (PARTITION BY thread_id ORDER BY pos) AS island FROM (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY thread_id ORDER BY pos) - 1 > 1 THEN 1 ELSE 0 END AS new FROM cov WHERE cov = 1))
  SELECT thread_id, island::BIGINT AS island, min(pos) AS first_pos, max(pos) AS last_pos, sum(hit)::BIGINT AS hits FROM i GROUP BY 1, 2""")
def ticket_segments(s, d):
    return sequences.islands(_covered(s, d), 1)


@query(f"{_COVERED} SELECT thread_id, round(avg(cov), 2) AS density, sum(hit)::BIGINT AS hits FROM cov GROUP BY 1")
def ticket_density(s, d):
    return sequences.density(_covered(s, d))


@query(f"""{_COVERED}, r AS (SELECT *, pos - row_number() OVER (PARTITION BY thread_id, cov ORDER BY pos) AS g, lag(id) OVER (PARTITION BY thread_id ORDER BY pos) AS b, lead(id) OVER (PARTITION BY thread_id ORDER BY pos) AS a FROM cov)
  SELECT thread_id, count(*) AS skipped, min(create_at) AS from_at, max(create_at) AS to_at, arg_min_null(b, pos) AS after_id, arg_max_null(a, pos) AS before_id FROM r WHERE cov = 0 GROUP BY thread_id, g""")
def timeline_skips(s, d):
    return sequences.timeline_skips(_covered(s, d))


@query("""SELECT thread_id, run::BIGINT AS run, min(user_id) AS user_id, count(*) AS posts, min(id) AS first_id FROM (
  SELECT *, sum(new) OVER (PARTITION BY thread_id ORDER BY create_at, id) AS run FROM (SELECT *, CASE WHEN lag(user_id) OVER (PARTITION BY thread_id ORDER BY create_at, id) = user_id THEN 0 ELSE 1 END AS new FROM live)) GROUP BY 1, 2""")
def author_runs(s, d):
    return sequences.author_runs(_posts(s, d))


@query("""SELECT thread_id, id, back FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY pos DESC) AS back FROM placed p JOIN (
  SELECT thread_id AS t, max(pos) AS m FROM placed WHERE message LIKE '%OPS-%' GROUP BY 1) ON t = thread_id WHERE pos > m) WHERE back <= 3""")
def outcome_window(s, d):
    return sequences.outcome_window(_posts(s, d), F.col("message").contains("OPS-"))


@query("SELECT a.id, (SELECT count(*) FROM live b WHERE b.thread_id = a.thread_id AND b.user_id <> a.user_id AND (b.create_at, b.id) > (a.create_at, a.id)) AS replies_after FROM live a")
def replies_after(s, d):
    return sequences.replies_after(_posts(s, d))


@query("""SELECT thread_id, id, pos FROM (SELECT *, max(CASE WHEN message LIKE '%approved%' THEN 1 ELSE 0 END) OVER (PARTITION BY thread_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near FROM placed) WHERE near = 1""")
def around_window(s, d):
    return sequences.around(_posts(s, d), F.col("message").contains("approved"), before=1, after=2)


@query("SELECT thread_id, id, back FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY create_at DESC, id DESC) AS back FROM live) WHERE back <= 2")
def latest_tail(s, d):
    return sequences.latest(_posts(s, d), 2)


@query("""SELECT id, min(greatest(a, b) - least(a, b) + 1) AS span FROM (SELECT x.id, x.pos AS a, y.pos AS b FROM toks x JOIN toks y USING (id) WHERE x.token = 'ops' AND y.token = 'proj') GROUP BY 1""")
def proximity_window(s, d):
    return sequences.covering_window(retrieval.token_rows(_live(s, d)), ["ops", "proj"]).select("id", F.col("span").cast("long").alias("span"))


@query("SELECT thread_id, least(5, count(*) FILTER (len(regexp_extract_all(lower(message), '[\\p{L}\\p{N}]+')) >= 6))::INT AS depth FROM live GROUP BY 1")
def substantive_depth(s, d):
    return ranking.thread_features(_posts(s, d), F.lit(False), ["proj"]).select("thread_id", "depth")


# --- selection and quality ------------------------------------------------------------


@query("SELECT source, arg_max(doc_id, (n_chars, -doc_id)) AS \"primary\" FROM documents GROUP BY 1", posts=False)
def primary_thread(s, d):
    return ranking.primary(s.read.parquet(f"{d}/documents.parquet").select("source", "doc_id", "n_chars"), "source", "n_chars", "doc_id")


@query("""SELECT grp, ord, thin, row_number() OVER (PARTITION BY grp ORDER BY CASE WHEN NOT thin AND n <= 2 THEN 0 WHEN thin AND n = 1 THEN 1 ELSE 2 END, ord) AS place FROM (
  SELECT source AS grp, doc_id AS ord, n_chars < 600 AS thin, row_number() OVER (PARTITION BY source, n_chars < 600 ORDER BY doc_id) AS n FROM documents)""", posts=False)
def thin_reserve_order(s, d):
    return ranking.thin_reserve(s.read.parquet(f"{d}/documents.parquet").selectExpr("source AS grp", "doc_id AS ord", "n_chars < 600 AS thin"), 3)


_RANKED = "SELECT source AS \"case\", row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank, quality + toxic AS grade FROM documents JOIN labels USING (doc_id)"


@query(f"""WITH r AS ({_RANKED}), i AS (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY grade DESC, rank) AS ideal FROM r)
  SELECT "case", round(count(*) FILTER (rank <= 10 AND grade > 0) / greatest(count(*) FILTER (grade > 0), 1), 6) AS recall, round(coalesce(max(CASE WHEN grade > 0 THEN 1.0::DOUBLE / rank END), 0), 6) AS rr,
  round(coalesce(sum(CASE WHEN rank <= 10 THEN (2.0 ** grade - 1) / log2(rank + 1) ELSE 0 END) / nullif(sum(CASE WHEN ideal <= 10 THEN (2.0 ** grade - 1) / log2(ideal + 1) ELSE 0 END), 0), 0), 6) AS ndcg FROM i GROUP BY 1""", posts=False)
def ndcg_recall_mrr(s, d):
    from pyspark.sql import Window

    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "n_chars").join(s.read.parquet(f"{d}/labels.parquet"), "doc_id")
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return metrics.ranking_quality(docs.select(F.col("source").alias("case"), rank.alias("rank"), (F.col("quality") + F.col("toxic")).alias("grade")))


@query("""WITH a AS (SELECT source, avg(n_chars) AS v FROM documents WHERE lang = 'en' GROUP BY 1), b AS (SELECT source, avg(n_chars) AS v FROM documents WHERE lang <> 'de' GROUP BY 1)
  SELECT source, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' WHEN a.v = b.v THEN 'same' ELSE 'changed' END AS status, round(b.v - a.v, 6) AS delta FROM a FULL JOIN b USING (source)""", posts=False)
def benchmark_compare(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet")
    report = lambda c: docs.where(c).groupBy("source").agg(F.avg("n_chars").alias("v"))
    return metrics.compare(report("lang = 'en'"), report("lang <> 'de'"), "source", "v")


@query("""SELECT grp, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM (
  SELECT lang AS grp, coalesce(count(*) FILTER (quality = 1 AND n_chars > 500)::DOUBLE / nullif(count(*) FILTER (n_chars > 500), 0), 1) AS p, coalesce(count(*) FILTER (quality = 1 AND n_chars > 500)::DOUBLE / nullif(count(*) FILTER (quality = 1), 0), 1) AS r
  FROM documents JOIN labels USING (doc_id) GROUP BY 1)""", posts=False)
def question_prf(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "n_chars").join(s.read.parquet(f"{d}/labels.parquet"), "doc_id")
    return metrics.precision_recall(docs.selectExpr("lang AS grp", "quality = 1 AS expected", "n_chars > 500 AS found"))


# --- packing --------------------------------------------------------------------------


def _packed(s, d):
    from weft.plans import packing

    return packing.pack(_posts(s, d), tables.users(s, d), F.col("message").contains("PROJ-1"), F.col("message").contains("approved"), 900)


@query()
def thread_packing(s, d):
    return _packed(s, d)


@query()
def packed_timeline(s, d):
    from weft.plans import packing

    return packing.timeline(_packed(s, d))


@query("SELECT p.id, nullif(regexp_extract(x, '/pl/([a-z0-9]{26})(?:[/?#]|$)', 1), '') AS target FROM (SELECT id, 'https://h/t/pl/' || lpad(replace(id, '-', ''), 26, 'a') || CASE WHEN delete_at = 0 THEN '' ELSE 'zz' END AS x FROM posts) p")
def permalinks(s, d):
    p = _posts(s, d).withColumn("x", F.concat(F.lit("https://h/t/pl/"), F.lpad(F.replace(F.col("id"), F.lit("-"), F.lit("")), 26, "a"), F.when(F.col("delete_at") == 0, "").otherwise("zz")))
    return p.select("id", F.nullif(T.permalink_id(F.col("x")), F.lit("")).alias("target"))


# --- more sequences and roll-ups ------------------------------------------------------


@query("SELECT a.thread_id, min(abs(a.pos - b.pos)) AS distance FROM placed a JOIN placed b USING (thread_id) WHERE a.message LIKE '%OPS-%' AND b.message LIKE '%approved%' GROUP BY 1")
def nearest_hits(s, d):
    return sequences.nearest_distance(_posts(s, d), F.col("message").contains("OPS-"), F.col("message").contains("approved"))


@query("""SELECT thread_id, id, chosen, chosen OR coalesce(nxt - prv - 1 <= 1, false) AS kept FROM (SELECT *, max(CASE WHEN chosen THEN pos END) OVER (PARTITION BY thread_id ORDER BY pos) AS prv,
  min(CASE WHEN chosen THEN pos END) OVER (PARTITION BY thread_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt FROM (SELECT *, message LIKE '%OPS-%' AS chosen FROM placed))""")
def bridged_clusters(s, d):
    return sequences.bridged(_posts(s, d), F.col("message").contains("OPS-"), 1)


@query("SELECT thread_id, min(pos) AS first_pos, max(pos) AS last_pos, max(pos) - min(pos) + 1 AS inside, max(pos) - min(pos) + 1 - count(*) AS holes FROM placed WHERE message LIKE '%OPS-%' GROUP BY 1")
def core_spans(s, d):
    return sequences.core_span(_posts(s, d), F.col("message").contains("OPS-"))


@query("""SELECT thread_id, pos, coalesce(last_value(a IGNORE NULLS) OVER (PARTITION BY thread_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(a IGNORE NULLS) OVER (PARTITION BY thread_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS at FROM (SELECT *, CASE WHEN pos % 3 <> 1 THEN create_at END AS a FROM placed)""")
def merged_chronology(s, d):
    items = sequences.placed(_posts(s, d)).select("thread_id", "pos", F.when(F.col("pos") % 3 != 1, F.col("create_at")).alias("at"))
    return sequences.chronology(items)


@query("SELECT thread_id, arg_min(ticket_key, (-n, ticket_key)) AS ticket_key, max(n) AS mentions FROM (SELECT thread_id, ticket_key, count(*) AS n FROM keys WHERE ticket_key <> 'PROJ-1' GROUP BY 1, 2) GROUP BY 1")
def dominant_ticket(s, d):
    return threads.dominant_ticket(_posts(s, d), "PROJ-1")


@query("""SELECT thread_id, max(score) AS score, array_to_string(list_sort(list_distinct(list(reason))), ',') AS reasons, max(create_at) AS latest_at FROM (
  SELECT thread_id, 2.0::DOUBLE AS score, 'ticket' AS reason, create_at FROM live WHERE message LIKE '%PROJ-%' UNION ALL SELECT thread_id, 1.0, 'cue', create_at FROM live WHERE message LIKE '%approved%') GROUP BY 1""")
def merged_candidates(s, d):
    p = _live(s, d)
    one = lambda word, score, reason: p.where(F.col("message").contains(word)).select("thread_id", F.lit(score).alias("score"), F.array(F.lit(reason)).alias("reasons"), F.col("create_at").alias("latest_at"))
    return threads.merge_candidates(one("PROJ-", 2.0, "ticket"), one("approved", 1.0, "cue")).withColumn("reasons", F.array_join("reasons", ","))


@query("SELECT ticket_key AS normalized_value, count(DISTINCT id) AS posts, min(id) AS first_post FROM keys GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def entity_rollup(s, d):
    rows = writes.entity_rows(_posts(s, d), tables.files(s, d)).where("kind = 'ticket'").withColumn("normalized_value", F.upper("normalized_value"))
    return threads.entity_rollup(rows, 5).select("normalized_value", "posts", "first_post")


@query("SELECT DISTINCT thread_id FROM live WHERE message LIKE '%PROJ-%' AND thread_id NOT IN (SELECT thread_id FROM live WHERE message LIKE '%approved%')")
def dropped_candidates(s, d):
    p = _live(s, d)
    return threads.dropped(p.where(F.col("message").contains("PROJ-")).select("thread_id").distinct(), p.where(F.col("message").contains("approved")))


@query("SELECT id, count(DISTINCT token) AS shared FROM toks WHERE token IN ('approved', 'proj', 'unclear', 'see') GROUP BY 1")
def overlap_terms(s, d):
    return threads.overlap_terms(_posts(s, d), "See the approved PROJ, or unclear")


@query("SELECT thread_id, ceil(avg(length(user_id) + 24 + length(message)))::BIGINT AS average_units FROM posts GROUP BY 1")
def average_units(s, d):
    p = _posts(s, d)
    return threads.rendered_units(p, tables.users(s, d)).join(p.select("id", "thread_id"), "id").groupBy("thread_id").agg(F.ceil(F.avg("units")).alias("average_units"))


@query("SELECT id, lower(hex(encode('outage'))) AS concept FROM live WHERE regexp_matches(lower(message), '(^|[^\\p{L}\\p{N}_])unclear($|[^\\p{L}\\p{N}_])')")
def concept_hits(s, d):
    from weft.functions import stems

    rows = _live(s, d).select("id", F.explode(stems.concept_tokens(F.col("message"), {"outage": ["unclear", "not reachable"]})).alias("token"))
    return rows.select("id", F.replace(F.col("token"), F.lit("zzconcept"), F.lit("")).alias("concept"))


from weft import queries_brief, queries_candidates, queries_diff, queries_evidence, queries_lookups, queries_packets, queries_search, queries_views  # noqa: E402, F401
