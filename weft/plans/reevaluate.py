"""Candidates against what their threads say now, for any number of requests at once, and pointers to threads outside a request's conversations.

Probes are a table (request, probe, value, term, n_terms): a row for each term, or one without a term whose
value is looked for. Candidates join their threads' posts and their own request's terms alone.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import subjects
from weft.functions.text import STOP_WORDS
from weft.operators.index import PostIndex
from weft.plans import channels

PROBES = "request string, probe int, value string, term string, n_terms int"
# Labels that a change of texts does not take away, and those that exempt a candidate from having matches; sizes of noisy terms; pointers of a request.
KEPT_LABELS = ("direct_post", "explicit_ticket_relationship", "remote_search", "rank_fusion", "conversation_priority", "latest_activity")
EXEMPT = ("direct_post", "explicit_ticket_relationship")
SHORT_TERM, SOFT_TERM, MOST_POINTERS = 4, 6, 5


def probe_table(spark, requests: dict[str, list[subjects.Probe]]) -> DataFrame:
    rows = [(r, i, p.value.lower(), t, len(p.terms)) for r, own in requests.items() for i, p in enumerate(own) for t in (p.terms or (None,))]
    return spark.createDataFrame(rows, PROBES)


def _holds(text: str, term: str) -> str:
    return f"rlike({text}, concat('(?<![\\\\p{{L}}\\\\p{{N}}_])\\\\Q', {term}, '\\\\E(?![\\\\p{{L}}\\\\p{{N}}_])'))"


def shown(candidates: DataFrame, posts: DataFrame, probes: DataFrame) -> DataFrame:
    """(request, thread_id, id, root, probe, term, n_terms): which live posts of candidate threads hold which terms."""
    live = posts.where("delete_at = 0").select("thread_id", "id", (F.col("id") == F.col("thread_id")).alias("root"), F.translate(F.lower("message"), "ё", "е").alias("low"))
    met = candidates.select("request", "thread_id").distinct().join(live, "thread_id").join(probes, "request")
    return met.where(F.expr(_holds("low", "coalesce(term, value)"))).select("request", "thread_id", "id", "root", "probe", F.coalesce("term", "value").alias("term"), "n_terms")


def qualified(found: DataFrame) -> DataFrame:
    """(request, thread_id, probe, ids): probes all of whose terms a thread holds, with the posts that hold any."""
    by = found.groupBy("request", "thread_id", "probe", "n_terms").agg(F.count_distinct("term").alias("n"), F.array_sort(F.collect_set("id")).alias("ids"))
    return by.where(F.col("n") >= F.greatest(F.col("n_terms"), F.lit(1))).select("request", "thread_id", "probe", "ids")


def reevaluated(candidates: DataFrame, posts: DataFrame, probes: DataFrame) -> DataFrame:
    """(request, thread_id, reasons, matching_ids, latest_activity_at, stays): candidates (request, thread_id, reasons) after their threads have changed.

    Labels that texts give are given anew, others are kept; stays: there still is a match, or none is needed.
    """
    found = shown(candidates, posts, probes)
    matches = qualified(found).groupBy("request", "thread_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("matching_ids"), F.count(F.lit(1)).alias("n_probes"))
    said = found.where("n_terms = 0").groupBy("request", "thread_id").agg(F.bool_or("root").alias("in_root"), F.bool_or(~F.col("root")).alias("in_reply"))
    latest = candidates.select("thread_id").distinct().join(posts, "thread_id").groupBy("thread_id").agg(F.max(F.greatest("create_at", "update_at", "delete_at")).alias("latest_activity_at"))
    rows = candidates.join(matches, ["request", "thread_id"], "left").join(said, ["request", "thread_id"], "left").join(latest, "thread_id", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    anew = [("exact_phrase", no(F.col("in_root") | F.col("in_reply"))), ("exact_phrase_in_root", no(F.col("in_root"))), ("exact_phrase_in_reply", no(F.col("in_reply"))), ("all_terms_in_thread", no(F.size("matching_ids") > 0)), ("multiple_probes_in_thread", no(F.col("n_probes") > 1))]
    kept = F.filter("reasons", lambda r: r.isin(*KEPT_LABELS) | r.startswith("routing_"))
    reasons = F.concat(kept, F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in anew])))
    stays = (F.size(F.coalesce("matching_ids", F.array().cast("array<string>"))) > 0) | F.arrays_overlap("reasons", F.array(*[F.lit(x) for x in EXEMPT]))
    return rows.select("request", "thread_id", reasons.alias("reasons"), F.coalesce("matching_ids", F.array().cast("array<string>")).alias("matching_ids"), "latest_activity_at", stays.alias("stays"))


def merged(*states: DataFrame) -> DataFrame:
    """(request, thread_id, reasons, matching_ids, fusion): one candidate for each thread of several states, with every label and match of each, and the larger fusion."""
    rows = states[0]
    for s in states[1:]:
        rows = rows.unionByName(s)
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return rows.groupBy("request", "thread_id").agg(union("reasons"), union("matching_ids"), F.max("fusion").alias("fusion"))


def noisy(probe: subjects.Probe) -> bool:
    """Whether a probe matches too broadly to point anywhere: short words, words beside stop words, soft words that are no identifiers."""
    words = lambda s: [subjects.normalize(w) for w in re.findall(r"[\w-]+", s)]
    for phrase in probe.phrases:
        own = [w for w in words(phrase) if len(w) > 1 and w not in STOP_WORDS]
        if len(own) > 1 or any(len(w) > SHORT_TERM for w in own):
            return False
    if not probe.terms:
        return len(subjects.normalize(probe.value).strip()) <= SHORT_TERM
    if len(probe.terms) > 1:
        return all(len(t) <= SHORT_TERM for t in probe.terms)
    (term,) = probe.terms
    said = words(probe.value)
    beside = any(a in STOP_WORDS and b not in STOP_WORDS and len(b) <= SHORT_TERM for x, y in zip(said[:-1], said[1:], strict=True) for a, b in ((x, y), (y, x)))
    return term in STOP_WORDS or beside or len(term) <= SHORT_TERM or (len(term) <= SOFT_TERM and not re.search(r"[-_\d]", term))


def background(index: PostIndex, requests: dict[str, list[subjects.Probe]], outside: DataFrame, selected: DataFrame) -> DataFrame:
    """(request, thread_id, probes, noise, place): up to MOST_POINTERS threads of other conversations for each ticket with probes of its own.

    requests: ticket to probes; outside: (id) of conversations that were not searched; selected: (request, thread_id) that were
    given out. A thread counts by the probes all of whose terms it holds; pointers that only noisy ones give come last.
    """
    spark = index.spark
    asked = {r: [p for p in own if p.value.strip().upper() != r] for r, own in requests.items()}
    asked = {r: own for r, own in asked.items() if own}
    numbers, strong = list(asked), []
    for k, r in enumerate(numbers):
        strong += channels.strong_requests(asked[r], len(strong), k)
    hits = channels.run(index, strong, outside)
    name = spark.createDataFrame(list(enumerate(numbers)), "subject int, request string")
    fused = channels.fusion(channels.contributions(hits)).join(name, "subject").select("request", "thread_id", "fusion").join(selected.select("request", "thread_id"), ["request", "thread_id"], "left_anti")
    hit = hits.select("subject", "thread_id", "probe").distinct().join(name, "subject").drop("subject")
    docs = index.table("docs").join(fused.select("thread_id").distinct(), "thread_id", "left_semi")
    held = qualified(shown(fused, docs, probe_table(spark, asked))).join(hit, ["request", "thread_id", "probe"], "left_semi")
    loud = spark.createDataFrame([(r, i, p.value, noisy(p)) for r, own in asked.items() for i, p in enumerate(own)], "request string, probe int, value string, noisy boolean")
    by = held.join(loud, ["request", "probe"]).groupBy("request", "thread_id").agg(F.array_sort(F.collect_set("value")).alias("probes"), F.bool_and("noisy").alias("noise")).join(fused, ["request", "thread_id"])
    order = lambda *more: Window.partitionBy("request").orderBy(*more, F.desc(F.round("fusion", 9)), "thread_id")
    best = by.withColumn("at", F.row_number().over(order())).where(F.col("at") <= MOST_POINTERS)
    return best.withColumn("place", F.row_number().over(order("noise"))).select("request", "thread_id", "probes", "noise", "place")
