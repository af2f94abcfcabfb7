"""Queries over decisions, questions, roles and briefs, with the cue tables as SQL values."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import cues as C
from weft.operators import brief, sequences
from weft.registry import _posts, also_held, held, query
from weft.sources import tables

SUBJECT = "PROJ-1"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rank(c: C.Cue) -> int:
    return 0 if c.note == "settled" else 2 if c.note == "punctuation" else 1


_VALUES = ", ".join(f"({_quoted(c.family)}, {_quoted(c.cue)}, {c.weight}, {_quoted(c.note)}, {str(c.exact).lower()}, {_quoted(C._plain(c.cue))}, {_rank(c)})" for c in C.CUES)
_HIT = "CASE WHEN {c}.exact THEN contains({p}, ' ' || {c}.key || ' ') ELSE contains({s}, {c}.key) END"
_PADDED = "' ' || regexp_replace({s}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g') || ' '"
_TOKEN = "CASE " + " ".join(f"WHEN regexp_matches(said, '^{t.replace('+', chr(92) + '+')}($|[^\\p{{L}}\\p{{N}}_])') THEN {_quoted(t)}" for t in C.ACKS) + " END"
_META = " OR ".join(f"contains(norm, {_quoted(C._plain(m))})" for m in C.META_REJECT)
_NEGATED = " OR ".join(f"contains(s.s, {_quoted(n + ' ')} || m.key)" for n in C.NEGATIONS)
_AFFIRMING = ", ".join(_quoted(t) for t in C.AFFIRMING)
_ASKED = r"len(list_filter(regexp_extract_all(regexp_replace(message, 'https?://\S+', ' ', 'gi'), '[^.!?\n]*[.!?\n]'), lambda x: ends_with(x, '?'))) > 0"
#: Posts with texts (sd), sentences (sen), cues that hold (hits: grp decision, rejected, question, scope or a role), their confidence (conf), acknowledgements (ak), kinds (dk), spans (sp).
BRIEF = rf""", cue(family, cue, weight, note, exact, key, rank) AS (VALUES {_VALUES}),
sd0 AS (SELECT *, replace(lower(message), 'ё', 'е') AS norm, replace(lower(trim(message)), 'ё', 'е') AS said, row_number() OVER (PARTITION BY thread_id ORDER BY create_at, id) AS pos FROM live WHERE regexp_matches(message, '\S')),
sd AS (SELECT *, {_PADDED.format(s='norm')} AS padded, CASE WHEN length(trim(message)) <= 30 THEN {_TOKEN} END AS tok FROM sd0),
sen AS MATERIALIZED (SELECT *, {_PADDED.format(s='s')} AS padded FROM (SELECT id, k, replace(lower(regexp_replace(x, '[.!?\n]$', '')), 'ё', 'е') AS s, regexp_extract(x, '[.!?\n]$') AS mark FROM (SELECT id, generate_subscripts(l, 1) AS k, unnest(l) AS x FROM (
  SELECT id, list_filter(regexp_extract_all(message, '[^.!?\n]*[.!?\n]|[^.!?\n]+$'), lambda y: regexp_matches(y, '[.!?\n]$') OR trim(y) <> '') AS l FROM sd)))),
m AS (SELECT sd.id, c.*, CASE WHEN family IN ('decision', 'tech_approach') THEN 'decision' WHEN family = 'open_question' THEN 'question' WHEN family = 'scope_refinement' THEN 'scope' ELSE family END AS grp FROM sd, cue c WHERE family <> 'hedge' AND {_HIT.format(c="c", s="norm", p="padded")}),
loc AS (SELECT m.id, m.cue, m.family, bool_or(NOT (m.grp IN ('decision', 'scope') AND s.mark = '?') AND NOT (m.grp = 'decision' AND ({_NEGATED}))) AS free FROM m JOIN sen s ON s.id = m.id AND {_HIT.format(c="m", s="s.s", p="s.padded")} GROUP BY ALL),
hits AS (SELECT m.* FROM m LEFT JOIN loc USING (id, cue, family) JOIN sd USING (id) WHERE coalesce(free, true) AND NOT (grp = 'decision' AND ({_META}))),
topc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, grp ORDER BY rank, weight DESC, cue) AS nth FROM hits) WHERE nth <= 5),
cf AS (SELECT id, grp, round(least(0.95, max(weight) + least(0.25, (count(*) - 1) * 0.08))::DOUBLE, 2) AS confidence, string_agg(cue, '|' ORDER BY nth) AS cues FROM topc GROUP BY 1, 2),
ak AS (SELECT d AS id, arg_min(id, pos) AS ack_id, arg_min(tok IN ({_AFFIRMING}), pos) AS affirming FROM (
  SELECT a.id AS d, b.id, b.pos, b.tok, row_number() OVER (PARTITION BY a.id ORDER BY b.pos) AS nth FROM sd a JOIN sd b ON a.thread_id = b.thread_id AND b.pos > a.pos AND b.user_id <> a.user_id) WHERE nth <= 2 AND tok IS NOT NULL GROUP BY 1),
hed AS (SELECT id, bool_and(h) AS hedged FROM (SELECT s.id, s.k, bool_or({_HIT.format(c="g", s="s.s", p="s.padded")}) AS h FROM (SELECT DISTINCT s.id, s.k, s.s, s.padded FROM sen s JOIN hits m ON m.id = s.id AND m.grp = 'decision' AND {_HIT.format(c="m", s="s.s", p="s.padded")}) s, cue g WHERE g.family = 'hedge' GROUP BY 1, 2) GROUP BY 1),
flags AS (SELECT id, bool_or(family = 'decision' AND note = 'settled') AS settled, bool_or(family = 'tech_approach') AS tech, bool_and(family = 'tech_approach') AS all_tech, bool_or(note = 'personal') AS personal FROM hits WHERE grp = 'decision' GROUP BY 1),
dk AS (SELECT id, CASE WHEN coalesce(hedged, false) OR all_tech THEN 'proposal' WHEN settled THEN 'approved_decision' WHEN tech THEN 'proposal' WHEN personal THEN CASE WHEN coalesce(affirming, false) THEN 'approved_decision' ELSE 'implementation_intent' END ELSE 'discussion_outcome' END AS kind
  FROM flags LEFT JOIN hed USING (id) LEFT JOIN ak USING (id)),
sp0 AS (SELECT thread_id, id, user_id, pos, create_at, message, CASE grp WHEN 'decision' THEN 'decision_candidate' WHEN 'rejected' THEN 'rejected_option_candidate' ELSE 'open_question_candidate' END AS kind, cues,
  CASE WHEN grp = 'decision' AND ack_id IS NOT NULL THEN round(least(0.95, confidence + 0.15), 2) ELSE confidence END AS confidence, CASE WHEN grp = 'decision' THEN dk.kind END AS decision_kind,
  CASE WHEN grp = 'question' THEN CASE WHEN {_ASKED} OR id IN (SELECT id FROM hits WHERE grp = 'question' AND note = 'unresolved') THEN 'question' ELSE 'follow_up' END END AS question_kind, CASE WHEN grp = 'decision' THEN ack_id END AS ack_id
  FROM cf JOIN sd USING (id) LEFT JOIN dk USING (id) LEFT JOIN ak USING (id) WHERE grp IN ('decision', 'rejected', 'question')),
sp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY coalesce((decision_kind <> 'approved_decision')::INT, 1), confidence DESC, id, kind) AS place FROM sp0) WHERE place <= 12),
bd AS (SELECT * EXCLUDE (place), rank AS place FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY list_position(['approved_decision', 'discussion_outcome', 'implementation_intent', 'proposal'], decision_kind), confidence DESC, id) AS rank FROM sp WHERE kind = 'decision_candidate' AND confidence >= 0.5) WHERE rank <= 5),
asked AS (SELECT * FROM sp WHERE kind = 'open_question_candidate' AND confidence >= 0.4 AND (cues <> '?' OR {_ASKED} AND id IN (SELECT id FROM keys WHERE ticket_key = '{SUBJECT}'))),
oq0 AS (SELECT a.thread_id, a.id, a.create_at, question_kind, confidence, (SELECT count(*) FROM sd b WHERE b.thread_id = a.thread_id AND b.pos > a.pos AND b.user_id <> a.user_id) AS replies_after, a.pos = (SELECT max(pos) FROM sd b WHERE b.thread_id = a.thread_id) AS is_tail FROM asked a WHERE id NOT IN (SELECT id FROM bd)),
oq AS (SELECT *, CASE WHEN question_kind <> 'question' THEN 'unknown' WHEN replies_after > 0 THEN 'possibly_answered' WHEN is_tail THEN 'unanswered' ELSE 'unknown' END AS resolution FROM (
  SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY is_tail DESC, question_kind = 'follow_up', replies_after, confidence DESC, create_at DESC, id) AS place FROM oq0) WHERE place <= 3),
rh AS (SELECT thread_id, substr(grp, 6) AS label, string_agg(DISTINCT id, '|' ORDER BY id) AS evidence FROM topc JOIN sd USING (id) WHERE starts_with(grp, 'role:') GROUP BY 1, 2),
rc AS (SELECT thread_id, label, string_agg(cue, '|' ORDER BY weight DESC, cue) AS cues, round(least(0.95, max(weight) + least(0.25, (count(*) - 1) * 0.08))::DOUBLE, 2) AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY thread_id, label ORDER BY weight DESC, cue) AS nth FROM (SELECT thread_id, substr(grp, 6) AS label, cue, max(weight) AS weight FROM topc JOIN sd USING (id) WHERE starts_with(grp, 'role:') GROUP BY ALL)) WHERE nth <= 5 GROUP BY 1, 2),
hd AS (SELECT id, bool_and(h) AS hedged FROM (SELECT s.id, s.k, bool_or({_HIT.format(c="g", s="s.s", p="s.padded")}) AS h FROM (SELECT DISTINCT s.id, s.k, s.s, s.padded FROM sen s JOIN hits m ON m.id = s.id AND m.family = 'decision' AND {_HIT.format(c="m", s="s.s", p="s.padded")}) s, cue g WHERE g.family = 'hedge' GROUP BY 1, 2) GROUP BY 1),
fl AS (SELECT id FROM (SELECT id, bool_or(note = 'settled') AS st, bool_or(note = 'personal') AS pe FROM hits WHERE family = 'decision' GROUP BY 1) LEFT JOIN hd USING (id) WHERE coalesce(hedged, false) OR NOT st AND pe),
rf AS (SELECT decision_id, id, nth FROM (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY pos) AS nth FROM (SELECT d.id AS decision_id, p.id, p.pos FROM bd d JOIN sd p ON p.thread_id = d.thread_id AND p.pos > d.pos AND p.pos <= d.pos + 6
  WHERE p.id IN (SELECT id FROM hits WHERE grp = 'scope') AND NOT EXISTS (SELECT 1 FROM sd q JOIN flags f ON f.id = q.id WHERE q.thread_id = d.thread_id AND q.pos > d.pos AND q.pos <= p.pos))) WHERE nth <= 2)
"""


def _said(s, d):
    # Read many times by one query; a lost executor's part is computed again.
    return held(brief.read(_posts(s, d)))


def _spans(s, d):
    return brief.candidate_spans(_said(s, d))


def _joined(df, *lists):
    return df.withColumns({c: F.array_join(c, "|") for c in lists})


@query(f"{BRIEF} SELECT id, family, cue, weight::DOUBLE AS weight FROM hits WHERE NOT starts_with(grp, 'role:')")
def cue_spans(s, d):
    """Each cue of each post that no question or negation voids."""
    every = F.concat("decision", "rejected", "question", "scope")
    return _said(s, d).select("id", F.explode(every).alias("c")).select("id", "c.family", "c.cue", (-F.col("c.minus")).alias("weight"))


@query(f"{BRIEF} SELECT id, grp, cues, confidence FROM cf WHERE grp IN ('decision', 'question')")
def cue_confidence(s, d):
    said = _said(s, d)
    one = lambda c: said.where(F.size(c) > 0).select("id", F.lit(c).alias("grp"), F.array_join(C.names(F.col(c)), "|").alias("cues"), C.confidence(F.col(c)).alias("confidence"))
    return one("decision").unionByName(one("question"))


@query(f"{BRIEF} SELECT a.id, ack_id, affirming FROM ak a WHERE id IN (SELECT id FROM flags)")
def ack_pairing(s, d):
    said = _said(s, d)
    return brief.acknowledgements(said).join(said.where(F.size("decision") > 0).select("id"), "id", "left_semi")


@query(f"{BRIEF} SELECT id, kind FROM dk")
def decision_kinds(s, d):
    return brief.candidate_spans(_said(s, d), None).where("kind = 'decision_candidate'").select("id", F.col("decision_kind").alias("kind"))


@query(f"{BRIEF} SELECT thread_id, id, kind, cues, confidence, decision_kind, question_kind, ack_id, place FROM sp")
def candidate_spans(s, d):
    return _joined(_spans(s, d).select("thread_id", "id", "kind", "cues", "confidence", "decision_kind", "question_kind", "ack_id", "place"), "cues")


@query(f"{BRIEF} SELECT thread_id, id, decision_kind, confidence, ack_id, place FROM bd")
def brief_decisions(s, d):
    return brief.brief_decisions(_spans(s, d)).select("thread_id", "id", "decision_kind", "confidence", "ack_id", "place")


@query(f"""{BRIEF} SELECT decision_id, id, back FROM (SELECT d.id AS decision_id, p.id, row_number() OVER (PARTITION BY d.id ORDER BY p.pos DESC)::INT AS back FROM bd d JOIN sd p ON p.thread_id = d.thread_id AND p.pos < d.pos AND p.pos >= d.pos - 6
  WHERE d.decision_kind IN ('approved_decision', 'discussion_outcome') AND length(d.message) <= 80 AND p.id IN (SELECT id FROM fl)) WHERE back <= 2""")
def decision_antecedents(s, d):
    said = _said(s, d)
    return brief.antecedents(said, brief.brief_decisions(brief.candidate_spans(said)))


@query(f"{BRIEF} SELECT decision_id, id, nth::INT AS nth FROM rf")
def scope_refinements(s, d):
    said = _said(s, d)
    return brief.refinements(said, brief.brief_decisions(brief.candidate_spans(said)))


def _questions(said):
    spans = also_held(brief.candidate_spans(said))
    return brief.open_questions(said, spans, brief.brief_decisions(spans), SUBJECT)


@query(f"{BRIEF} SELECT thread_id, id, question_kind, confidence, replies_after, is_tail, resolution, place FROM oq")
def open_questions(s, d):
    return _questions(_said(s, d)).select("thread_id", "id", "question_kind", "confidence", "replies_after", "is_tail", "resolution", "place")


@query(f"""{BRIEF} SELECT question_id, id, nth FROM (SELECT q.id AS question_id, p.id, row_number() OVER (PARTITION BY q.id ORDER BY p.pos) AS nth FROM oq q JOIN sd a ON a.id = q.id JOIN sd p ON p.thread_id = q.thread_id AND p.pos > a.pos AND p.user_id <> a.user_id) WHERE nth <= 3""")
def question_responses(s, d):
    said = _said(s, d)
    return brief.responses(said, _questions(said))


@query(f"{BRIEF} SELECT thread_id, label, evidence, cues, confidence FROM rh JOIN rc USING (thread_id, label)")
def role_hints(s, d):
    return _joined(brief.role_hints(_said(s, d)), "evidence", "cues")


@query(f"""{BRIEF} SELECT thread_id, arg_min(did, o) AS decision_id, arg_min(aid, o) AS ack_id, arg_min(round(least(0.7, 0.45 + least(0.15, confidence * 0.2)), 2), o) AS confidence FROM (
  SELECT d.thread_id, d.id AS did, a.id AS aid, d.confidence, (list_position(['approved_decision', 'discussion_outcome', 'implementation_intent', 'proposal'], d.decision_kind), -d.confidence, d.id, -a.pos) AS o
  FROM bd d JOIN (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY create_at DESC, id DESC) AS back FROM sd) a ON a.thread_id = d.thread_id AND a.pos > d.pos AND a.user_id <> d.user_id
  WHERE back <= 8 AND a.tok IN ({_AFFIRMING}) AND a.id NOT IN (SELECT ack_id FROM bd WHERE ack_id IS NOT NULL)
    AND (SELECT count(*) FROM sd b WHERE b.thread_id = d.thread_id AND b.pos > d.pos AND b.pos < a.pos AND b.user_id <> d.user_id) > 2) GROUP BY 1""")
def late_acknowledgements(s, d):
    said = _said(s, d)
    return brief.late_acknowledgements(said, brief.brief_decisions(brief.candidate_spans(said)))


_NOISE = f"""(SELECT thread_id FROM (SELECT thread_id, count(*) AS n, max(length(trim(message))) AS l, count(*) FILTER (id IN (SELECT id FROM keys WHERE ticket_key = '{SUBJECT}')) AS named, count(*) FILTER (id IN (SELECT id FROM keys WHERE ticket_key <> '{SUBJECT}')) AS other FROM live GROUP BY 1) WHERE n <= 3 AND l <= 160 AND named > 0 AND other = 0)"""


#: Previews of threads: the ends of the messages of their first two posts.
_PREVIEW = "pv AS (SELECT thread_id, right(message, 150) AS message FROM placed WHERE pos <= 2 AND delete_at = 0)"


@query(f""", {_PREVIEW}, kp AS (SELECT thread_id, message, list_transform(regexp_extract_all(message, '\\b[A-Za-z][A-Za-z0-9]+-[0-9]+\\b'), lambda k: upper(k)) AS k FROM pv)
  SELECT thread_id FROM kp GROUP BY 1 HAVING count(*) <= 3 AND max(length(trim(message))) <= 160 AND count(*) FILTER (list_contains(k, '{SUBJECT}')) > 0 AND count(*) FILTER (len(list_filter(k, lambda x: x <> '{SUBJECT}')) > 0) = 0""")
def noise_threads(s, d):
    previews = sequences.placed(_posts(s, d)).where("pos <= 2").withColumn("message", F.right("message", F.lit(150)))
    return brief.noise_threads(previews, SUBJECT)


@query(f"""{BRIEF}, aq AS (SELECT thread_id, max(confidence) AS c, count(DISTINCT id) AS n FROM sp WHERE kind = 'open_question_candidate' AND (cues <> '?' OR {_ASKED} AND id IN (SELECT id FROM keys WHERE ticket_key = '{SUBJECT}')) GROUP BY 1),
  h AS (SELECT thread_id, 'decision' AS label, max(confidence) AS confidence FROM bd GROUP BY 1
    UNION ALL SELECT thread_id, 'open_question', CASE WHEN coalesce(tail, false) THEN greatest(coalesce(c, 0), 0.55) ELSE c END FROM aq FULL JOIN (SELECT DISTINCT thread_id, true AS tail FROM oq WHERE is_tail) USING (thread_id) WHERE c >= 0.5 OR n >= 3 OR tail
    UNION ALL SELECT thread_id, 'debugging', max(confidence) FROM rc WHERE label IN ('testing', 'regression', 'implementation') GROUP BY 1
    UNION ALL SELECT thread_id, 'status', confidence FROM rc WHERE label = 'coordination' AND thread_id NOT IN (SELECT thread_id FROM bd)),
  g AS (SELECT * FROM h UNION ALL SELECT thread_id, 'noise', 0.6 FROM {_NOISE} WHERE thread_id NOT IN (SELECT thread_id FROM h))
  SELECT thread_id, label, confidence::DOUBLE AS confidence, place FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY list_position(['decision', 'open_question', 'debugging', 'announce', 'status', 'noise'], label), confidence DESC) AS place FROM g) WHERE place <= 3""")
def purpose_hints(s, d):
    p, said = _posts(s, d), _said(s, d)
    spans = also_held(brief.candidate_spans(said))
    made = brief.brief_decisions(spans)
    return brief.purpose_hints(p, said, spans, made, _questions(said), brief.role_hints(said), SUBJECT)


@query(f"""{BRIEF} SELECT thread_id, label, string_agg(id, '|' ORDER BY create_at, id) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY thread_id, label ORDER BY create_at DESC, id DESC) AS back FROM (
  SELECT DISTINCT thread_id, grp AS label, id, create_at FROM topc JOIN sd USING (id) WHERE starts_with(grp, 'role:'))) WHERE back <= 2 GROUP BY 1, 2""")
def hint_evidence(s, d):
    said = _said(s, d)
    rows = brief.role_hints(said).select("thread_id", F.concat(F.lit("role:"), "label").alias("label"), F.explode("evidence").alias("id")).join(said.select("id", "create_at"), "id")
    return _joined(brief.capped_evidence(rows, ["thread_id", "label"], 2), "evidence")


_OUTCOME = f"""(SELECT id FROM (SELECT p.*, row_number() OVER (PARTITION BY p.thread_id ORDER BY pos DESC) AS back FROM placed p JOIN (SELECT thread_id AS t, max(pos) AS m FROM placed WHERE delete_at = 0 AND id IN (SELECT id FROM keys WHERE ticket_key = '{SUBJECT}') GROUP BY 1) ON t = thread_id WHERE pos > m AND delete_at = 0) WHERE back <= 5)"""


@query(f"""{BRIEF}, e AS (SELECT id FROM bd UNION SELECT ack_id FROM bd UNION SELECT id FROM rf UNION SELECT id FROM oq UNION SELECT id FROM (SELECT p.id, row_number() OVER (PARTITION BY q.id ORDER BY p.pos) AS nth FROM oq q JOIN sd a ON a.id = q.id JOIN sd p ON p.thread_id = q.thread_id AND p.pos > a.pos AND p.user_id <> a.user_id) WHERE nth <= 3
    UNION SELECT id FROM {_OUTCOME} UNION SELECT id FROM live WHERE id IN (SELECT post_id FROM files WHERE delete_at = 0)),
  k AS (SELECT thread_id, id FROM posts WHERE id IN (SELECT id FROM e WHERE id IS NOT NULL))
  SELECT * FROM k UNION ALL SELECT thread_id, arg_max(id, (create_at, id)) AS id FROM posts WHERE thread_id NOT IN (SELECT thread_id FROM k) GROUP BY 1""")
def brief_retained(s, d):
    from weft.functions import text as T

    p, said = _posts(s, d), _said(s, d)
    spans = also_held(brief.candidate_spans(said))
    made, asked = brief.brief_decisions(spans), _questions(said)
    outcome = sequences.outcome_window(p, (F.col("delete_at") == 0) & F.array_contains(T.ticket_keys(F.col("message")), SUBJECT), 5, live=True)
    return brief.retained_posts(p, tables.files(s, d), made, brief.refinements(said, made), asked, brief.responses(said, asked), outcome)


@query(f"""{BRIEF} SELECT DISTINCT thread_id, id FROM (SELECT thread_id, id FROM sp UNION ALL SELECT thread_id, ack_id FROM sp WHERE ack_id IS NOT NULL UNION ALL SELECT thread_id, id FROM topc JOIN sd USING (id) WHERE starts_with(grp, 'role:'))""")
def cited_posts(s, d):
    said = _said(s, d)
    return brief.cited_posts(brief.candidate_spans(said), brief.role_hints(said))


@query(f"""{BRIEF} SELECT family, cue, count(DISTINCT id) AS matched, count(DISTINCT CASE WHEN NOT coalesce(free, true) THEN id END) AS guard_rejected, count(DISTINCT CASE WHEN nth <= 5 THEN id END) AS reported
  FROM m LEFT JOIN loc USING (id, cue, family) LEFT JOIN (SELECT id, family, cue, row_number() OVER (PARTITION BY id ORDER BY rank, weight DESC, cue) AS nth FROM m LEFT JOIN loc USING (id, cue, family) WHERE grp = 'decision' AND coalesce(free, true)) USING (id, cue, family) WHERE grp = 'decision' GROUP BY 1, 2""")
def cue_telemetry(s, d):
    return brief.cue_stages(_said(s, d))


@query(f"{BRIEF} SELECT id, {' OR '.join(f'contains(norm, {_quoted(C._plain(x))})' for x in C.OFFLINE_MARKERS)} AS offline, {_META} AS meta FROM sd")
def decision_marks(s, d):
    return _said(s, d).select("id", C.is_offline(F.col("ready")).alias("offline"), C.is_meta(F.col("ready")).alias("meta"))
