"""Queries over the stored index: batched retrieval, and the search that ranks what it finds by the full score vector."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft import queries_evidence as Q
from weft.functions.subjects import trigram_policy
from weft.operators import ranking, retrieval, routing
from weft.plans import channels, search
from weft.registry import _index, query
from weft.sources import tables

#: Subjects of a batch, each with further queries; one has a typo, which only the weak pass finds.
BATCH = [("PROJ-1", []), ("OPS-3", ["approved"]), ("approved unclear", []), ("still unclear", ["propose wait"]), ("the backend", []), ("aproved", []), ('"sounds good" thanks', ["qa stand"])]
SEARCHED = ("PROJ-1", ["approved", "still unclear"])


def _requests(batch) -> list[channels.Request]:
    """The strong requests, and typo requests for single words that no post holds."""
    out: list[channels.Request] = []
    for k, (subject, more) in enumerate(batch):
        out += channels.strong_requests(search.subject_of(subject, more)[1], len(out), k)
    return out


def _retrieved(requests: list[channels.Request], typos: list[channels.Request] = (), scope: str = "true") -> str:
    """rk: (request, subject, probe, source, query, id, thread_id, rank) of the best hits; ct: contributions of threads."""
    rows = []
    for r in requests:
        words = channels.words_of(r.value)
        phrase = r.channel in ("exact_phrase", "term_fts") and len(words) > 1
        words = words if phrase else list(dict.fromkeys(words))
        rows.append(f"({r.number}, {r.subject}, {r.probe}, '{r.source}', '{r.value}', '{'phrase' if phrase else 'bm25'}', {1 if r.channel == 'broad_fts' else len(words)}, {words})")
    fuzzy = " ".join(
        f"""UNION ALL SELECT {r.number}, id, max(sim) FROM (SELECT id, 2.0 * len(list_intersect(g, {sorted({r.value[i : i + 3] for i in range(len(r.value) - 2)})})) / (len(g) + {len({r.value[i : i + 3] for i in range(len(r.value) - 2)})}) AS sim
        FROM (SELECT DISTINCT id, token, list_distinct(list_transform(range(1, length(token) - 1), lambda i: token[i:i + 2])) AS g FROM toks WHERE length(token) >= 3 AND levenshtein(token, '{r.value}') <= {trigram_policy(r.value)[1]})) GROUP BY id HAVING max(sim) >= {trigram_policy(r.value)[0]}"""
        for r in typos
    )
    rows += [f"({r.number}, {r.subject}, {r.probe}, '{r.source}', '{r.value}', 'typo', 1, ['{r.value}'])" for r in typos]
    weights = " ".join(f"WHEN '{k}' THEN {v}" for k, v in retrieval.WEIGHTS.items())
    idf = lambda df: f"CASE WHEN ln((nd - {df} + 0.5) / ({df} + 0.5)) <= 0 THEN 1e-6 ELSE ln((nd - {df} + 0.5) / ({df} + 0.5)) END"
    part = lambda df: f"({idf(df)}) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_len))"
    return f"""rq(request, subject, probe, source, query, kind, need, words) AS (VALUES {', '.join(rows)}),
rt AS (SELECT request, kind, need, unnest(words) AS token, generate_subscripts(words, 1) - 1 AS place FROM rq),
dl AS (SELECT id, len(regexp_extract_all(lower(message), '[\\p{{L}}\\p{{N}}]+')) AS n, count(*) OVER () AS nd, avg(len(regexp_extract_all(lower(message), '[\\p{{L}}\\p{{N}}]+'))) OVER () AS avg_len FROM live),
tf AS (SELECT token, id, count(*)::DOUBLE AS tf, count(*) OVER (PARTITION BY token) AS df FROM toks WHERE token IN (SELECT token FROM rt) GROUP BY 1, 2),
ph AS (SELECT *, count(*) OVER (PARTITION BY request) AS df FROM (SELECT request, id, count(*)::DOUBLE AS tf FROM (SELECT request, id, pos - place AS st FROM rt JOIN toks USING (token) WHERE kind = 'phrase' GROUP BY request, need, id, st HAVING count(*) = need) GROUP BY 1, 2)),
sc AS (SELECT request, id, sum({part('df')}) AS score FROM rt JOIN tf USING (token) JOIN dl USING (id) WHERE kind = 'bm25' GROUP BY request, need, id HAVING count(*) >= need
  UNION ALL SELECT request, id, {part('df')} FROM ph JOIN dl USING (id) {fuzzy}),
rk AS (SELECT rq.*, id, thread_id, rank FROM (SELECT request, s.id, thread_id, row_number() OVER (PARTITION BY request ORDER BY round(score, 12) DESC, create_at DESC, s.id) AS rank FROM sc s JOIN live USING (id) WHERE {scope}) JOIN rq USING (request) WHERE rank <= {channels.MOST_HITS}),
ct AS (SELECT subject, thread_id, probe, source, max(w / (60 + place)) AS score FROM (SELECT subject, thread_id, probe, source, CASE source {weights} END AS w, row_number() OVER (PARTITION BY request ORDER BY min(rank)) AS place FROM rk GROUP BY request, subject, thread_id, probe, source) GROUP BY ALL)"""


def _typos() -> list[channels.Request]:
    n = len(_requests(BATCH))
    return [channels.Request(n, 0, "trigram", "trigram", "aproved", 5)]


@query(f""", {_retrieved(_requests(BATCH), _typos())} SELECT subject, thread_id, round(fusion, 9)::DOUBLE AS fusion, sources, place FROM (
  SELECT subject, thread_id, sum(score ORDER BY probe, source) AS fusion, string_agg(source, '|' ORDER BY probe, source) AS sources, row_number() OVER (PARTITION BY subject ORDER BY round(sum(score ORDER BY probe, source), 9) DESC, thread_id)::INT AS place FROM ct GROUP BY 1, 2) WHERE place <= 50""")
def retrieval_batch(s, d):
    rows = search.fused_batch(_index(s, d), BATCH, 50)
    return rows.select("subject", "thread_id", F.round("fusion", 9).alias("fusion"), F.array_join("sources", "|").alias("sources"), "place")


@query(f""", {_retrieved(_requests(BATCH), _typos())} SELECT request, subject, id, rank::INT AS rank FROM rk""")
def retrieval_hits(s, d):
    found = channels.retrieve_batch(_index(s, d), [channels.Subject(search.subject_of(*x)[1]) for x in BATCH])
    return found.select("request", "subject", "id", "rank")


_PROBES = search.subject_of(*SEARCHED)[1]
_FUSED = f"{_retrieved(_requests([SEARCHED]))}, fz AS (SELECT thread_id, round(sum(score ORDER BY probe, source), 9)::DOUBLE AS fusion FROM ct GROUP BY 1)"
_SEARCH = Q._vectors_sql(Q._threads(_PROBES), f", {_FUSED}{Q._segments('id IN (SELECT id FROM rk)', 8, 2)}", "nothing AS (SELECT 1)", "false", "c.priority")


@query(f"{_SEARCH} SELECT thread_id, {Q._COLUMNS} FROM v WHERE fusion > 0 ORDER BY {Q._ORDER}, thread_id LIMIT 10")
def thread_search(s, d):
    return search.search(_index(s, d), *SEARCHED, routed=routing.route(tables.conversations(s)))
