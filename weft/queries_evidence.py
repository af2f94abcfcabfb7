"""Queries over ticket segments, probe evidence and the score vector of candidate threads."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions.subjects import Probe
from weft.operators import evidence, ranking, routing
from weft.registry import _posts, query
from weft.sources import tables

SUBJECT = "PROJ-1"
PROBES = [Probe("still unclear", "generic", (), ("still", "unclear")), Probe("ops proj", "generic", (), ("ops", "proj")), Probe("approved", "generic", (), ("approved",))]
_SAYS = r"regexp_matches(lower(message), '(^|[^\p{{L}}\p{{N}}_]){0}($|[^\p{{L}}\p{{N}}_])')"



def _segments(match: str, ticket_radius: int, match_radius: int) -> str:
    """Segments: cov (coverage), tm (metrics)."""
    return f""", pk AS (SELECT p.*, count(*) OVER (PARTITION BY thread_id) AS n, id IN (SELECT id FROM keys WHERE ticket_key = '{SUBJECT}') AS ticket, {match} AS m FROM placed p),
pe AS (SELECT *, m AND NOT ticket AS match, min(CASE WHEN ticket THEN pos END) OVER (PARTITION BY thread_id) AS f, max(CASE WHEN ticket THEN pos END) OVER (PARTITION BY thread_id) AS l FROM pk),
cov AS (SELECT *, CASE WHEN f = 1 AND l = 1 OR pos BETWEEN f - {ticket_radius} AND l + {ticket_radius} THEN 'ticket' WHEN max(match::INT) OVER (PARTITION BY thread_id ORDER BY pos ROWS BETWEEN {match_radius} PRECEDING AND {match_radius} FOLLOWING) = 1 THEN 'match' END AS kind FROM pe),
oc AS (SELECT thread_id, ticket_key, count(*) AS c FROM keys WHERE ticket_key <> '{SUBJECT}' GROUP BY 1, 2),
tm0 AS (SELECT thread_id, count(*) AS posts, count(kind) AS window_posts, count(*) FILTER (ticket) AS subject_mentions, coalesce(any_value(o.other), 0)::BIGINT AS other_mentions, coalesce(bool_or(ticket AND pos = 1), false) AS ticket_in_root, coalesce(bool_or(f = 1 AND l = 1), false) AS root_anchored, any_value(o.dominant_other) AS dominant_other
  FROM cov LEFT JOIN (SELECT thread_id, sum(c) AS other, arg_min(ticket_key, (-c, ticket_key)) AS dominant_other FROM oc GROUP BY 1) o USING (thread_id) GROUP BY 1),
tm AS (SELECT *, round(window_posts / posts, 2) AS density, subject_mentions > 0 AND other_mentions = 0 AS exclusive, subject_mentions > 0 AND NOT root_anchored AND other_mentions > 0 AND posts >= 8 AND other_mentions >= 2 * subject_mentions AS dominated, CASE WHEN subject_mentions > 0 THEN 0 END AS nearest,
  (SELECT min(abs(a.pos - b.pos)) FROM cov a JOIN cov b ON a.thread_id = b.thread_id WHERE a.thread_id = tm0.thread_id AND a.ticket AND b.match) AS nearest_match FROM tm0)
"""


SEGMENTS = _segments("message LIKE '%approved%'", 1, 1)


def _covered(s, d):
    return evidence.coverage(_posts(s, d), SUBJECT, F.col("message").contains("approved"), 1, 1)


@query(f"""{SEGMENTS} SELECT *, CASE WHEN exclusive OR root_anchored THEN false WHEN dominated OR subject_mentions = 0 THEN true ELSE density < 0.5 END AS historical_neighbour FROM tm""")
def ticket_metrics(s, d):
    return evidence.ticket_metrics(_covered(s, d), SUBJECT)


@query(f"""{SEGMENTS}, ins AS (SELECT *, kind IS NOT NULL OR coalesce(nx - pv - 1 <= 1, false) AS inside FROM (SELECT *, max(CASE WHEN kind IS NOT NULL THEN pos END) OVER (PARTITION BY thread_id ORDER BY pos) AS pv,
    min(CASE WHEN kind IS NOT NULL THEN pos END) OVER (PARTITION BY thread_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx FROM cov)),
  sg AS (SELECT *, sum(new) OVER (PARTITION BY thread_id ORDER BY pos) AS segment FROM (SELECT *, CASE WHEN inside <> lag(inside) OVER (PARTITION BY thread_id ORDER BY pos) THEN 1 ELSE 0 END AS new FROM ins))
  SELECT thread_id, segment::BIGINT AS segment, arg_min(id, pos) AS start_id, arg_max(id, pos) AS end_id, count(*) AS posts, CASE WHEN bool_or(inside) THEN CASE WHEN coalesce(bool_or(kind = 'ticket'), false) THEN 'ticket_window' ELSE 'match_window' END
    WHEN bool_and(pv IS NOT NULL) AND bool_and(nx IS NOT NULL) AND count(*) >= 2 THEN 'omitted_gap' ELSE 'off_topic_gap' END AS reason FROM sg GROUP BY 1, 2""")
def ticket_window_segments(s, d):
    return evidence.segments(_covered(s, d), merge_gap=1, hydrate=2)


def _shown(i: int, p: Probe) -> str:
    """Evidence of one probe for each post; terms are plain words, so exact and stem positions agree."""
    terms = list(p.terms)
    spans = f"(SELECT min(greatest({', '.join(f'x{j}.pos' for j in range(len(terms)))}) - least({', '.join(f'x{j}.pos' for j in range(len(terms)))}) + 1) FROM {' JOIN '.join(f'(SELECT * FROM toks WHERE token = {t!r} AND pos < 512) x{j}' + (' USING (id)' if j else '') for j, t in enumerate(terms))} WHERE x0.id = p.id)"
    if len(terms) == 1:
        spans = f"(SELECT CASE WHEN count(*) > 0 THEN 1 END FROM toks x WHERE x.id = p.id AND x.token = {terms[0]!r} AND x.pos < 512)"
    said = " + ".join(f"({_SAYS.format(t)})::INT" for t in terms)
    held = " + ".join(f"(p.id IN (SELECT id FROM toks WHERE token = {t!r} AND pos < 512))::INT" for t in terms)
    bits = ", ".join(f"CASE WHEN {_SAYS.format(t)} THEN {j} END" for j, t in enumerate(terms))
    at = ", ".join(f"CASE WHEN p.id IN (SELECT id FROM toks WHERE token = {t!r} AND pos < 512) THEN {j} END" for j, t in enumerate(terms))
    return f"SELECT p.*, {i} AS probe, {len(terms)} AS terms, {_SAYS.format(p.value.lower())} AS phrase, {said} AS n_said, {held} AS n_held, {spans} AS span, [{bits}] AS said, [{at}] AS held FROM posts p"


def _probes(probes: list[Probe]) -> str:
    return f""", ev AS ({' UNION ALL '.join(_shown(i, p) for i, p in enumerate(probes))}),
pb0 AS (SELECT thread_id, probe, any_value(terms) AS terms, bool_or(phrase AND id = thread_id) AS phrase_in_root, bool_or(phrase AND id <> thread_id) AS phrase_in_reply, len(list_distinct(flatten(list(said))))::INT AS exact_terms,
  len(list_distinct(list_concat(flatten(list(said)), flatten(list(held)))))::INT AS matched_terms, max(n_held) AS same_post, len(list_distinct(flatten(list(held))))::INT AS across, min(span) AS win FROM ev GROUP BY 1, 2),
pb AS (SELECT *, CASE WHEN terms >= 2 THEN CASE WHEN win <= 8 THEN 'exact_terms_near' WHEN same_post = terms THEN 'exact_terms_same_post' WHEN across = terms THEN 'terms_across_thread' END END AS kind,
  phrase_in_root OR phrase_in_reply OR matched_terms > 0 AS matched, phrase_in_root OR phrase_in_reply OR exact_terms = terms AS exact_full, phrase_in_root OR phrase_in_reply OR matched_terms = terms AS full_ FROM pb0)"""


_PROBES = _probes(PROBES)


@query(f"{_PROBES} SELECT thread_id, probe, phrase_in_root, phrase_in_reply, exact_terms, matched_terms, across, win AS window_tokens, kind, matched, exact_full, full_ AS full_match FROM pb")
def probe_proximity(s, d):
    rows = evidence.probe_evidence(evidence.post_evidence(_posts(s, d), PROBES), PROBES)
    return rows.select("thread_id", "probe", "phrase_in_root", "phrase_in_reply", "exact_terms", "matched_terms", "across", F.col("window").alias("window_tokens"), "kind", "matched", "exact_full", F.col("full").alias("full_match"))


def _threads(probes: list[Probe]) -> str:
    return f"""{_probes(probes)}, tier AS (SELECT *, CASE kind WHEN 'exact_terms_near' THEN 6 WHEN 'exact_terms_same_post' THEN 4 WHEN 'terms_across_thread' THEN 1 ELSE 0 END AS tier FROM pb),
tb AS (SELECT thread_id, count(*) FILTER (phrase_in_root) AS phrases_in_root, count(*) FILTER (phrase_in_reply) AS phrases_in_reply, count(*) FILTER (matched) AS matched_probes, count(*) FILTER (full_) AS full_probes, count(*) FILTER (exact_full) AS exact_full_probes,
  sum(matched_terms)::BIGINT AS matched_terms, sum(matched_terms - exact_terms)::BIGINT AS morph_terms, min(win) AS win, max(tier) AS tier, arg_max(kind, (tier, -probe)) AS kind FROM tier GROUP BY 1),
rel AS (SELECT thread_id, max(greatest(create_at, delete_at)) AS latest_match_at, count(DISTINCT id) AS matching_posts FROM ev WHERE phrase OR n_said > 0 OR n_held > 0 GROUP BY 1),
wl AS (SELECT thread_id, any_value(conversation_id) AS conversation_id, count(*) AS posts_in_thread, least(5, count(*) FILTER (len(regexp_extract_all(message, '[\\p{{L}}\\p{{N}}]+')) >= 6)) AS substantive,
  sum(len(regexp_extract_all(regexp_replace(regexp_replace(message, 'https?://\\S+', ' ', 'gi'), '{SUBJECT}', ' ', 'gi'), '[\\p{{L}}\\p{{N}}]+'))) AS residual, max(greatest(create_at, delete_at)) AS latest_activity_at,
  bool_or(id = thread_id AND {_SAYS.format('proj-1')}) AS root_says, bool_or(id <> thread_id AND {_SAYS.format('proj-1')}) AS reply_says, bool_or(id = thread_id AND id IN (SELECT id FROM keys GROUP BY 1 HAVING count(DISTINCT ticket_key) >= 3 AND bool_or(ticket_key = '{SUBJECT}'))) AS br FROM posts GROUP BY 1),
te AS (SELECT *, CASE WHEN phrases_in_root > 0 AND substantive >= 3 THEN substantive ELSE 0 END AS depth, substantive < 3 AND residual <= 4 AS thin_stub, br AND NOT reply_says AS bulletin FROM wl JOIN tb USING (thread_id) LEFT JOIN rel USING (thread_id))"""


_THREADS = _threads(PROBES)


@query(f"""{_THREADS} SELECT thread_id, phrases_in_root, phrases_in_reply, matched_probes, full_probes, exact_full_probes, matched_terms, win AS window_tokens, tier, kind, latest_match_at, matching_posts, posts_in_thread, substantive, latest_activity_at, root_says, reply_says, depth, thin_stub, bulletin FROM te""")
def thread_evidence(s, d):
    rows = evidence.thread_evidence(_posts(s, d), PROBES, SUBJECT).withColumnRenamed("window", "window_tokens")
    return rows.select("thread_id", "phrases_in_root", "phrases_in_reply", "matched_probes", "full_probes", "exact_full_probes", "matched_terms", "window_tokens", "tier", "kind", "latest_match_at", "matching_posts", "posts_in_thread", "substantive", "latest_activity_at", "root_says", "reply_says", "depth", "thin_stub", "bulletin")


_HITS = """h AS (SELECT id, thread_id, 'exact_phrase' AS source, 0 AS probe FROM live WHERE message LIKE '%PROJ-1' OR message LIKE '%PROJ-1 %'
  UNION ALL SELECT id, thread_id, 'term_fts', 1 FROM live WHERE message LIKE '%approved%' UNION ALL SELECT id, thread_id, 'term_fts', 0 FROM live WHERE message LIKE '%OPS-2%')"""
_LINKS = "(SELECT thread_id FROM posts WHERE id LIKE '%7-0000')"
def _vectors_sql(threads: str, segments: str, fused: str, linked: str, priority: str) -> str:
    """v: the score vectors; fused ends with fz (thread_id, fusion)."""
    return f"""{threads}{segments}, {fused},
st AS (SELECT thread_id, count(*) AS structured FROM keys WHERE ticket_key = '{SUBJECT}' GROUP BY 1),
v0 AS (SELECT te.*, tm.density, tm.root_anchored, tm.exclusive, tm.dominated, tm.nearest, coalesce(fusion, 0) AS fusion, coalesce(structured, 0) AS structured, {linked} AS linked, 1 AS routing, {priority} AS priority, thin_stub OR bulletin AS low
  FROM te JOIN conf c ON c.id = conversation_id LEFT JOIN tm USING (thread_id) LEFT JOIN fz USING (thread_id) LEFT JOIN st USING (thread_id)),
v AS (SELECT thread_id, bulletin, thin_stub, kind, phrases_in_root, phrases_in_reply, exact_full_probes, full_probes, morph_terms, matched_probes, depth, root_says, reply_says, linked, 0 AS direct, linked::INT AS explicit_ticket, (root_says AND NOT low)::INT AS ticket_in_root, (reply_says OR root_says AND low)::INT AS ticket_in_reply,
  CASE WHEN low OR NOT (root_says OR reply_says) OR dominated THEN 0 WHEN root_anchored OR exclusive THEN 3 WHEN density >= 0.4 THEN 2 ELSE 1 END AS ticket_focus, 0 AS subject_in_root, CASE WHEN low THEN 0 ELSE phrases_in_root END AS phrase_in_root,
  exact_full_probes + full_probes AS full_coverage, tier AS proximity_tier, CASE WHEN tier >= 3 THEN 513 - win ELSE 0 END AS proximity_window, structured AS structured_matches, routing,
  CASE WHEN bulletin THEN -2 WHEN thin_stub THEN -1 ELSE depth + CASE WHEN dominated THEN 0 ELSE least(floor(density * 10 + 0.5), greatest(1, depth + 1)) + CASE WHEN root_anchored THEN 2 ELSE 0 END + CASE WHEN root_says OR coalesce(nearest = 0, false) THEN 1 ELSE 0 END END END AS thread_depth,
  fusion, matched_terms, phrases_in_reply + CASE WHEN low THEN phrases_in_root ELSE 0 END AS phrase_in_reply, priority, coalesce(latest_match_at, 0) AS latest_match_at, latest_activity_at
  FROM v0 WHERE fusion > 0 OR structured > 0 OR linked OR root_says OR reply_says)"""


_FUSED = f"""{_HITS}, fz AS (SELECT thread_id, round(sum(w / (60 + rank)), 9)::DOUBLE AS fusion FROM (
  SELECT thread_id, CASE source WHEN 'exact_phrase' THEN 1.0 ELSE 0.75 END AS w, row_number() OVER (PARTITION BY probe, source ORDER BY min(id)) AS rank FROM h GROUP BY thread_id, probe, source) GROUP BY 1)"""
_VECTORS = _vectors_sql(_THREADS, SEGMENTS, _FUSED, f"te.thread_id IN {_LINKS}", "c.priority")
_COLUMNS = ", ".join(f"{x}::DOUBLE AS {x}" for x in ranking.FULL_VECTOR)
_ORDER = ", ".join(f"{x}::DOUBLE DESC" for x in ranking.FULL_VECTOR)


def _vectors(s, d):
    from weft import queries

    p = _posts(s, d)
    structured = p.where(F.col("delete_at") == 0).select("thread_id", F.explode(evidence.T.ticket_keys(F.col("message"))).alias("k")).where(F.col("k") == SUBJECT).groupBy("thread_id").agg(F.count(F.lit(1)).alias("n"))
    links = p.where(F.col("id").endswith("7-0000")).select("thread_id")
    metrics = evidence.ticket_metrics(_covered(s, d), SUBJECT)
    return evidence.vectors(evidence.thread_evidence(p, PROBES, SUBJECT), metrics, routing.route(tables.conversations(s)), queries.rrf_fusion(s, d), structured, links)


@query(f"{_VECTORS} SELECT thread_id, {_COLUMNS} FROM v ORDER BY {_ORDER}, thread_id LIMIT 20")
def candidate_rank_vector(s, d):
    return ranking.order(_vectors(s, d), 20).select("thread_id", *ranking.FULL_VECTOR)


@query(f"{_VECTORS} SELECT thread_id, {_COLUMNS} FROM v")
def candidate_rank_vector_all(s, d):
    return ranking.order(_vectors(s, d)).select("thread_id", *ranking.FULL_VECTOR)


@query(f"""{_VECTORS} SELECT thread_id, array_to_string(list_filter([CASE WHEN linked THEN 'explicit_ticket_relationship' END, CASE WHEN root_says THEN 'ticket_in_root' END, CASE WHEN reply_says THEN 'ticket_in_reply' END, CASE WHEN structured_matches > 0 THEN 'structured_entity_match' END,
  CASE WHEN phrases_in_root + phrases_in_reply > 0 THEN 'exact_phrase' END, CASE WHEN phrases_in_root > 0 THEN 'exact_phrase_in_root' END, CASE WHEN phrases_in_reply > 0 THEN 'exact_phrase_in_reply' END, CASE WHEN exact_full_probes > 0 THEN 'all_terms_in_thread' END,
  CASE WHEN full_probes > exact_full_probes THEN 'all_expanded_terms_in_thread' END, kind, CASE WHEN morph_terms > 0 THEN 'morphology_match' END, CASE WHEN matched_probes > 1 THEN 'multiple_probes_in_thread' END, CASE WHEN depth > 0 THEN 'substantive_thread_depth' END,
  CASE WHEN thin_stub THEN 'thin_thread' END, CASE WHEN bulletin THEN 'multi_ticket_root' END, CASE WHEN fusion > 0 THEN 'rank_fusion' END, 'routing_all_configured', 'conversation_priority', 'latest_activity'], lambda x: x IS NOT NULL), '|') AS reasons FROM v""")
def candidate_reasons(s, d):
    return evidence.reasons(_vectors(s, d), F.lit("all_configured")).select("thread_id", F.array_join("reasons", "|").alias("reasons"))
