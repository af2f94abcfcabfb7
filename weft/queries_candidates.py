"""Candidates after their threads have changed, and background pointers."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft import queries_search as S
from weft.functions.subjects import Probe
from weft.plans import channels, reevaluate
from weft.registry import _index, _posts, query

REQUESTS = {"PROJ-1": [Probe("still unclear", "generic", ()), Probe("approved ops", "generic", (), ("approved", "ops"))], "OPS-2": [Probe("approved", "generic", (), ("approved",)), Probe("qa stand", "generic", (), ("qa", "stand"))]}
_SAYS = r"regexp_matches(lower(message), '(^|[^\p{L}\p{N}_])' || term || '($|[^\p{L}\p{N}_])')"
_TERMS = ", ".join(f"('{r}', {i}, {len(p.terms)}, '{t}')" for r, own in REQUESTS.items() for i, p in enumerate(own) for t in (p.terms or (p.value,)))


def _found(source: str) -> str:
    """Which posts hold which terms, and what qualifies."""
    return f"""tm(request, probe, n_terms, term) AS (VALUES {_TERMS}), cd AS (SELECT DISTINCT ticket_key AS request, thread_id FROM keys WHERE ticket_key IN ({', '.join(f"'{r}'" for r in REQUESTS)})),
fd AS (SELECT request, thread_id, id, id = thread_id AS root, probe, term, n_terms FROM cd JOIN {source} USING (thread_id) JOIN tm USING (request) WHERE delete_at = 0 AND {_SAYS}),
ql AS (SELECT request, thread_id, probe, n_terms FROM fd GROUP BY ALL HAVING count(DISTINCT term) >= greatest(n_terms, 1))"""


@query(f""", ed AS (SELECT * REPLACE (CASE WHEN id LIKE '%2' THEN replace(replace(message, 'approved', 'revoked'), 'still unclear', 'now clear') ELSE message END AS message, CASE WHEN id LIKE '%2' THEN create_at + 5 ELSE create_at END AS create_at) FROM posts), {_found('ed')},
m AS (SELECT request, thread_id, string_agg(DISTINCT id, '|' ORDER BY id) AS ids, count(DISTINCT probe) AS n FROM fd JOIN ql USING (request, thread_id, probe) GROUP BY 1, 2),
sd AS (SELECT request, thread_id, bool_or(root) AS a, bool_or(NOT root) AS b FROM fd WHERE n_terms = 0 GROUP BY 1, 2),
la AS (SELECT thread_id, max(greatest(create_at, delete_at)) AS latest_activity_at FROM ed GROUP BY 1)
SELECT cd.request, cd.thread_id, array_to_string(list_filter([CASE WHEN request = 'OPS-2' AND thread_id LIKE '%3-0000' THEN 'direct_post' END, 'routing_all_configured', CASE WHEN a OR b THEN 'exact_phrase' END, CASE WHEN a THEN 'exact_phrase_in_root' END, CASE WHEN b THEN 'exact_phrase_in_reply' END,
  CASE WHEN ids IS NOT NULL THEN 'all_terms_in_thread' END, CASE WHEN n > 1 THEN 'multiple_probes_in_thread' END], lambda x: x IS NOT NULL), '|') AS reasons, coalesce(ids, '') AS matching_ids, latest_activity_at, ids IS NOT NULL OR request = 'OPS-2' AND thread_id LIKE '%3-0000' AS stays
FROM cd LEFT JOIN m USING (request, thread_id) LEFT JOIN sd USING (request, thread_id) JOIN la USING (thread_id)""")
def reevaluated_candidates(s, d):
    """Candidates of two tickets, after edits have taken matches away."""
    p = _posts(s, d)
    keyed = p.where("delete_at = 0").select(F.explode(F.array_distinct(reevaluate.channels.T.ticket_keys(F.col("message")))).alias("request"), "thread_id").where(F.col("request").isin(*REQUESTS)).distinct()
    direct = F.when((F.col("request") == "OPS-2") & F.col("thread_id").endswith("3-0000"), "direct_post")
    candidates = keyed.withColumn("reasons", F.array_compact(F.array(direct, F.lit("routing_all_configured"), F.lit("exact_phrase"), F.lit("all_terms_in_thread"))))
    changed = F.col("id").endswith("2")
    text = F.replace(F.replace(F.col("message"), F.lit("approved"), F.lit("revoked")), F.lit("still unclear"), F.lit("now clear"))
    edited = p.withColumns({"message": F.when(changed, text).otherwise(F.col("message")), "create_at": F.when(changed, F.col("create_at") + 5).otherwise(F.col("create_at"))}).withColumn("update_at", F.col("create_at"))
    out = reevaluate.reevaluated(candidates, edited, reevaluate.probe_table(s, REQUESTS))
    return out.withColumns({"reasons": F.array_join("reasons", "|"), "matching_ids": F.array_join("matching_ids", "|")})


def _strong() -> list[channels.Request]:
    out: list[channels.Request] = []
    for k, own in enumerate(REQUESTS.values()):
        out += channels.strong_requests(own, len(out), k)
    return out


_NOISY = ", ".join(f"('{r}', {i}, '{p.value}', {str(reevaluate.noisy(p)).lower()})" for r, own in REQUESTS.items() for i, p in enumerate(own))


@query(f""", {S._retrieved(_strong(), scope="conversation_id IN ('c2', 'c3')")}, rn(subject, request) AS (VALUES {', '.join(f"({k}, '{r}')" for k, r in enumerate(REQUESTS))}), {_found('posts')},
fu AS (SELECT request, thread_id, sum(score ORDER BY probe, source) AS fusion FROM ct JOIN rn USING (subject) WHERE (request, thread_id) NOT IN (SELECT (ticket_key, thread_id) FROM keys) GROUP BY 1, 2),
ff AS (SELECT request, thread_id, probe FROM fu JOIN posts USING (thread_id) JOIN tm USING (request) WHERE delete_at = 0 AND {_SAYS} GROUP BY request, thread_id, probe, n_terms HAVING count(DISTINCT term) >= greatest(n_terms, 1)),
ps AS (SELECT request, thread_id, string_agg(DISTINCT value, '|' ORDER BY value) AS probes, bool_and(noisy) AS noise, any_value(fusion) AS fusion FROM ff JOIN fu USING (request, thread_id) JOIN (VALUES {_NOISY}) n(request, probe, value, noisy) USING (request, probe)
  WHERE (request, thread_id, probe) IN (SELECT (rn.request, thread_id, probe) FROM rk JOIN rn USING (subject)) GROUP BY 1, 2)
SELECT request, thread_id, probes, noise, row_number() OVER (PARTITION BY request ORDER BY noise, round(fusion, 9) DESC, thread_id)::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY round(fusion, 9) DESC, thread_id) AS at_ FROM ps) WHERE at_ <= 5""")
def background_pointers(s, d):
    """Threads of two conversations that were not searched, which do not name the ticket."""
    outside = s.createDataFrame([("c2",), ("c3",)], "id string")
    selected = _posts(s, d).where("delete_at = 0").select(F.explode(F.array_distinct(reevaluate.channels.T.ticket_keys(F.col("message")))).alias("request"), "thread_id").distinct()
    return reevaluate.background(_index(s, d), REQUESTS, outside, selected).withColumn("probes", F.array_join("probes", "|"))
