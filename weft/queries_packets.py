"""Queries over the choice of threads, packets and their judgement. Each conversation stands for a request here."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import text as T
from weft.operators import brief, selection
from weft.plans import core
from weft.queries_brief import BRIEF, SUBJECT, _questions, _said
from weft.queries_evidence import _vectors
from weft.registry import _posts, also_held, query
from weft.sources import tables

_REASONS = "CASE number % 4 WHEN 0 THEN 'thin_thread|exact_phrase' WHEN 1 THEN 'ticket_in_root|substantive_thread_depth' WHEN 2 THEN 'latest_activity' ELSE 'exact_terms_near|latest_activity' END"
#: A packet and candidates that follow from thread numbers: q (candidates), pk (packet).
_Q = f""", t AS (SELECT thread_id, any_value(conversation_id) AS request, substr(thread_id, 6, 5)::INT AS number, count(*) AS total_posts, count(*) FILTER (delete_at <> 0) AS omitted_posts FROM posts GROUP BY thread_id),
q AS (SELECT request, thread_id, number AS ord, string_split({_REASONS}, '|') AS reasons, number % 3 = 0 AS selected, number % 7 = 1 AS no_match, number % 11 = 2 AS unavailable FROM t),
pk AS (SELECT t.*, number AS rank, string_split({_REASONS}, '|') AS reasons, omitted_posts AS largest_skip, number % 5 = 1 AS root_anchored, number % 6 = 1 AS exclusive, number % 8 = 3 AS dominated, (number % 10) / 10 AS density, number % 9 = 4 AND request <> 'c0' AS pending FROM t WHERE number % 3 = 0),
sc AS (SELECT *, round(CASE WHEN list_has_any(reasons, ['thin_thread', 'multi_ticket_root']) THEN -100 ELSE 0 END + CASE WHEN root_anchored THEN 50 ELSE 0 END + CASE WHEN exclusive THEN 40 ELSE 0 END - CASE WHEN dominated THEN 80 ELSE 0 END + floor(density * 10 + 0.5) + CASE WHEN list_contains(reasons, 'substantive_thread_depth') THEN 20 ELSE 0 END
  + least(total_posts, 12) - omitted_posts * 0.01, 4) AS score, omitted_posts > 0 AND (omitted_posts / total_posts >= 0.25 OR largest_skip >= 5) AS full_ FROM pk),
pr AS (SELECT request, arg_max(thread_id, (score, -rank)) AS primary_thread FROM sc GROUP BY 1),
ct AS (SELECT request, count(*) AS candidate_threads, count(*) FILTER (selected) AS returned_threads, count(*) FILTER (NOT selected AND list_contains(reasons, 'thin_thread')) AS dropped_thin, count(*) FILTER (NOT selected AND NOT no_match AND NOT unavailable) AS dropped_by_budget,
  count(*) FILTER (NOT selected AND NOT no_match AND NOT unavailable AND list_has_any(reasons, [{', '.join(f"'{r}'" for r in selection.SUBJECT_REASONS)}])) AS dropped_subject, count(*) FILTER (NOT selected AND no_match) AS dropped_no_match FROM q GROUP BY 1),
dr AS (SELECT *, drop_reason = 'thin' OR list_has_any(reasons, ['ticket_in_root', 'ticket_in_reply', 'explicit_ticket_relationship']) AS actionable FROM (SELECT *, CASE WHEN unavailable THEN 'unavailable' WHEN no_match THEN 'no_match' WHEN list_contains(reasons, 'thin_thread') THEN 'thin' ELSE 'budget' END AS drop_reason FROM q WHERE NOT selected)),
dp AS (SELECT request, thread_id, drop_reason, place FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY actionable DESC, drop_reason <> 'thin', ord) AS place FROM dr WHERE actionable OR list_has_any(reasons, [{', '.join(f"'{r}'" for r in selection.MATCH_REASONS)}])) WHERE place <= 5),
fs AS (SELECT id AS request, id = 'c1' AS stale, id <> 'c2' AS complete FROM conf),
st AS (SELECT request, adequacy, currency, discovery, selected_threads, selection, index_history, can_answer, CASE WHEN coalesce(dropped_subject, 0) > 0 THEN 'subject_matched_budget_drops' WHEN discovery = 'possibly_stale' THEN 'stale_discovery' WHEN index_history = 'cutoff_bounded' AND NOT (can_answer AND currency = 'current') THEN 'index_cutoff' END AS missed_reason,
  currency <> 'current' AS may_be_stale, omitted_posts, largest_skip FROM (SELECT *, adequacy = 'usable' AND selected_threads = 'complete' AND NOT coalesce(pending, false) AS can_answer FROM (
    SELECT f.request, CASE WHEN threads IS NULL THEN 'insufficient' WHEN only_thin THEN 'thin' ELSE 'usable' END AS adequacy, CASE WHEN stale THEN 'possibly_stale' ELSE 'current' END AS currency, CASE WHEN stale THEN 'possibly_stale' ELSE 'current' END AS discovery,
      CASE WHEN threads IS NULL THEN 'not_applicable' WHEN cut THEN 'truncated' ELSE 'complete' END AS selected_threads, CASE WHEN coalesce(dropped_by_budget, 0) > 0 THEN 'budget_bounded' ELSE 'complete' END AS selection, CASE WHEN complete THEN 'full' ELSE 'cutoff_bounded' END AS index_history, pending, omitted_posts, largest_skip, dropped_subject
    FROM fs f LEFT JOIN (SELECT request, count(*) AS threads, bool_and(list_contains(reasons, 'thin_thread')) AS only_thin, bool_or(full_) AS cut, bool_or(pending) AS pending, sum(omitted_posts)::BIGINT AS omitted_posts, max(largest_skip) AS largest_skip FROM sc GROUP BY 1) USING (request) LEFT JOIN ct USING (request)))),
fu AS (SELECT request, thread_id, row_number() OVER (PARTITION BY request ORDER BY thread_id <> primary_thread, largest_skip DESC, omitted_posts / total_posts DESC, thread_id) AS place FROM sc JOIN pr USING (request) WHERE full_)
"""


def _threads(s, d):
    by = _posts(s, d).groupBy("thread_id").agg(F.any_value("conversation_id").alias("request"), F.count(F.lit(1)).alias("total_posts"), F.count_if(F.col("delete_at") != 0).alias("omitted_posts"))
    return by.withColumn("number", F.substring("thread_id", 6, 5).cast("int")).withColumn("reasons", F.split(F.expr(_REASONS), r"\|"))


def _candidates(s, d):
    return _threads(s, d).selectExpr("request", "thread_id", "number AS ord", "reasons", "number % 3 = 0 AS selected", "number % 7 = 1 AS no_match", "number % 11 = 2 AS unavailable")


def _packet(s, d):
    return _threads(s, d).where("number % 3 = 0").selectExpr("*", "number AS rank", "omitted_posts AS largest_skip", "number % 5 = 1 AS root_anchored", "number % 6 = 1 AS exclusive", "number % 8 = 3 AS dominated", "(number % 10) / 10 AS density", "number % 9 = 4 AND request <> 'c0' AS pending")


def _status(s, d):
    fresh = tables.conversations(s).selectExpr("id AS request", "id = 'c1' AS stale", "id <> 'c2' AS complete")
    return selection.status(_packet(s, d), fresh, selection.counters(_candidates(s, d)))


@query(f"{_Q} SELECT * FROM ct")
def selection_counters(s, d):
    return selection.counters(_candidates(s, d))


@query(f"{_Q} SELECT * FROM dp")
def dropped_with_reasons(s, d):
    return selection.dropped(_candidates(s, d))


@query(f"{_Q} SELECT thread_id, list_has_any(reasons, [{', '.join(repr(r) for r in selection.SUBJECT_REASONS)}]) AS pinned FROM q")
def pinned_candidates(s, d):
    return _candidates(s, d).select("thread_id", selection.pinned().alias("pinned"))


@query(f"{_Q} SELECT request, primary_thread FROM pr")
def primary_threads(s, d):
    return selection.primary_threads(_packet(s, d)).withColumnRenamed("primary", "primary_thread")


@query(f"{_Q} SELECT * FROM fu")
def truncated_threads(s, d):
    return selection.truncated(_packet(s, d))


@query(f"{_Q} SELECT * FROM st")
def evidence_status(s, d):
    return _status(s, d)


@query(f"""{_Q} SELECT request, array_to_string(list_filter([CASE WHEN request IN (SELECT request FROM fu) THEN 'thread_full:recommended' END, CASE WHEN may_be_stale AND currency <> 'local_only' THEN 'fresh_or_remote:recommended' END, CASE WHEN missed_reason = 'index_cutoff' THEN 'sync:optional' END,
  CASE WHEN request IN (SELECT request FROM dp WHERE drop_reason = 'thin') THEN 'inspect_dropped:optional' END, CASE WHEN request IN (SELECT request FROM dp WHERE drop_reason = 'budget') AND missed_reason = 'subject_matched_budget_drops' THEN 'review_candidates:recommended' END, CASE WHEN adequacy = 'insufficient' THEN 'widen:recommended' END], lambda x: x IS NOT NULL), '|') AS actions FROM st""")
def next_actions(s, d):
    out = selection.next_actions(_status(s, d), selection.truncated(_packet(s, d)), selection.dropped(_candidates(s, d)))
    return out.select("request", F.array_join("actions", "|").alias("actions"))


_BD = "(SELECT b.*, conversation_id AS request FROM bd b JOIN (SELECT id, conversation_id FROM posts) USING (id))"
_OQ = "(SELECT o.*, conversation_id AS request FROM oq o JOIN (SELECT id, conversation_id FROM posts) USING (id))"
_OPEN = "resolution IN ('unanswered', 'unknown') AND question_kind = 'question'"


def _decisions(s, d):
    return brief.brief_decisions(brief.candidate_spans(_said(s, d))).join(_posts(s, d).select("id", F.col("conversation_id").alias("request")), "id")


def _asked(s, d):
    return _questions(_said(s, d)).join(_posts(s, d).select("id", F.col("conversation_id").alias("request")), "id")


@query(f"{BRIEF} SELECT request, thread_id, id, decision_kind, place FROM (SELECT * EXCLUDE (place), row_number() OVER (PARTITION BY request ORDER BY list_position(['approved_decision', 'discussion_outcome', 'implementation_intent', 'proposal'], decision_kind), create_at DESC, id) AS place FROM {_BD}) WHERE place <= 5")
def merged_decisions(s, d):
    return selection.merged_decisions(_decisions(s, d))


@query(f"{BRIEF} SELECT request, thread_id, id, open, place FROM (SELECT * EXCLUDE (place), {_OPEN} AS open, row_number() OVER (PARTITION BY request ORDER BY {_OPEN} DESC, is_tail DESC, question_kind = 'follow_up', replies_after, create_at DESC, id) AS place FROM {_OQ}) WHERE open OR place <= 3")
def merged_questions(s, d):
    return selection.merged_questions(_asked(s, d))


@query(f"""{BRIEF} SELECT coalesce(a.request, b.request) AS request, {', '.join(f"coalesce({k}, 0) AS {k}" for k in brief.PRIORITY)}, coalesce(unresolved, 0) AS unresolved FROM (SELECT request, {', '.join(f"count(*) FILTER (decision_kind = '{k}') AS {k}" for k in brief.PRIORITY)} FROM {_BD} GROUP BY 1) a
  FULL JOIN (SELECT request, count(*) FILTER ({_OPEN}) AS unresolved FROM {_OQ} GROUP BY 1) b ON a.request = b.request""")
def research_summary(s, d):
    return selection.summary(_decisions(s, d), _asked(s, d))


@query(f"""{BRIEF} SELECT request, thread_id, post_id, file_id, files FROM (SELECT request, thread_id, id AS post_id, (SELECT min(f.id) FROM files f WHERE f.post_id = x.id AND delete_at = 0 AND ends_with(name, '.csv')) AS file_id, (SELECT count(*) FROM files f WHERE f.post_id = x.id AND delete_at = 0 AND ends_with(name, '.csv')) AS files,
  row_number() OVER (PARTITION BY request ORDER BY create_at DESC, id) AS r FROM (SELECT DISTINCT p.id, p.thread_id, p.create_at, p.conversation_id AS request FROM (SELECT id FROM bd UNION SELECT id FROM rf UNION SELECT id FROM oq) e JOIN live p USING (id)) x WHERE EXISTS (SELECT 1 FROM files f WHERE f.post_id = x.id AND delete_at = 0 AND ends_with(name, '.csv'))) WHERE r = 1""")
def decision_data_attachments(s, d):
    said = _said(s, d)
    made = also_held(brief.brief_decisions(brief.candidate_spans(said)))
    ids = made.select("id").union(brief.refinements(said, made).select("id")).union(_questions(said).select("id"))
    p = _posts(s, d)
    return selection.latest_attachments(p, tables.files(s, d), ids.join(p.select("id", F.col("conversation_id").alias("request")), "id"), ["csv", "json", "xlsx"])


_GAPS = ", sk AS (SELECT *, pos - row_number() OVER (PARTITION BY thread_id, keep ORDER BY pos) AS grp FROM (SELECT *, message LIKE '%OPS-%' AS keep, message LIKE '%approved%' AS win, pos > 3 AS gap FROM placed))"


@query(f"{_GAPS} SELECT thread_id, grp::BIGINT AS run, count(*) AS skipped, CASE WHEN bool_or(gap) THEN 'omitted_gap' WHEN NOT bool_or(win) THEN 'outside_ticket_window' ELSE 'budget' END AS reason FROM sk WHERE NOT keep GROUP BY 1, 2")
def skip_reasons(s, d):
    from pyspark.sql import Window

    from weft.operators import sequences

    p = sequences.placed(_posts(s, d)).withColumn("keep", F.col("message").contains("OPS-"))
    run = F.col("pos") - F.row_number().over(Window.partitionBy("thread_id", "keep").orderBy("pos"))
    rows = p.withColumn("run", run.cast("long")).where(~F.col("keep")).select("thread_id", "run", "id", F.col("message").contains("approved").alias("in_window"), (F.col("pos") > 3).alias("in_gap"))
    return selection.skip_reasons(rows)


@query(f"{_GAPS} SELECT thread_id, max(n) AS largest_skip FROM (SELECT thread_id, grp, count(*) AS n FROM sk WHERE NOT keep GROUP BY 1, 2) GROUP BY 1")
def largest_skips(s, d):
    return skip_reasons(s, d).groupBy("thread_id").agg(F.max("skipped").alias("largest_skip"))


@query()
def context_packet(s, d):
    """The flagship packet; its greedy packing has no SQL and is held against a plain one in tests."""
    from weft.plans import context

    return context.context(_vectors(s, d), _posts(s, d), tables.users(s, d), F.col("message").contains(SUBJECT), F.col("message").contains("approved"), 4000, 4)


@query()
def ticket_packets(s, d):
    """A packet for every ticket of the corpus: no SQL for the choice, which tests hold against a plain pass."""
    p = _posts(s, d)
    edges = p.where("delete_at = 0").select("id", "thread_id", F.explode(F.array_distinct(T.ticket_keys(F.col("message")))).alias("ticket_key"))
    linked = p.where("id LIKE '%3-0000' AND id = thread_id").select(F.lit("PROJ-1").alias("request"), "thread_id")
    return core.packets(core.placed(p, tables.users(s, d), tables.files(s, d), core.threads_of(edges, linked), "message LIKE '%approved%'"))
