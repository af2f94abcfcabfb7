"""What a thread shows for a request: ticket segments, probe and proximity evidence, score vector, reasons.

posts are whole threads (id, thread_id, conversation_id, user_id, create_at, update_at,
delete_at, message), probes a short list. Each step is one aggregate or window by thread.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import stems
from weft.functions import text as T
from weft.functions.subjects import Probe
from weft.operators import sequences
from weft.operators.ranking import FULL_VECTOR

MOST_TERMS, MOST_TOKENS, NEAR = 8, 512, 8
KINDS = {"exact_terms_near": 6, "morph_terms_near": 5, "exact_terms_same_post": 4, "morph_terms_same_post": 3, "expanded_terms_same_post": 1, "terms_across_thread": 1}


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _norm(text: Column) -> Column:
    return F.translate(F.lower(text), "ё", "е")


# --- segments by distance from the ticket -----------------------------------------------


def coverage(posts: DataFrame, subject: str, match: Column, ticket_radius: int = 8, match_radius: int = 2) -> DataFrame:
    """posts with pos, ticket, match, n, kind: "ticket" or "match" where a window around hits covers a post.

    A ticket in the root alone covers the whole thread; two hits or more cover all between
    them; a ticket window covers what a match window would.
    """
    p = sequences.placed(posts).withColumns({"keys": T.ticket_keys(F.col("message")), "n": F.count(F.lit(1)).over(Window.partitionBy("thread_id"))})
    p = p.withColumn("ticket", F.array_contains("keys", subject.upper()))
    p = p.withColumn("match", _flag(match) & ~F.col("ticket"))
    every, order = Window.partitionBy("thread_id"), Window.partitionBy("thread_id").orderBy("pos")
    hit = F.when(F.col("ticket"), F.col("pos"))
    p = p.withColumns({"first_hit": F.min(hit).over(every), "last_hit": F.max(hit).over(every), "base": F.min("pos").over(every)})
    near = F.max(F.col("match").cast("int")).over(order.rowsBetween(-match_radius, match_radius)) == 1
    anchored = _flag(F.col("first_hit") == F.col("base")) & (F.col("last_hit") == F.col("base"))
    kind = F.when(anchored | F.col("pos").between(F.col("first_hit") - ticket_radius, F.col("last_hit") + ticket_radius), "ticket").when(near, "match")
    return p.withColumns({"anchored": _flag(anchored), "kind": kind})


def ticket_metrics(covered: DataFrame, subject: str) -> DataFrame:
    """(thread_id, posts, density, ...): counts, focus and the ticket beside the subject, of each thread."""
    key = subject.upper()
    other = F.filter("keys", lambda k: k != key)
    by = covered.groupBy("thread_id").agg(
        F.count(F.lit(1)).alias("posts"),
        F.count("kind").alias("window_posts"),
        F.count_if("ticket").alias("subject_mentions"),
        F.sum(F.size(other)).alias("other_mentions"),
        F.bool_or(F.col("ticket") & (F.col("pos") == F.col("base"))).alias("ticket_in_root"),
        F.bool_or("anchored").alias("root_anchored"),
    )
    counts = covered.select("thread_id", F.explode(other).alias("key")).groupBy("thread_id", "key").agg(F.count(F.lit(1)).alias("c"))
    dominant = counts.groupBy("thread_id").agg(F.min_by("key", F.struct(-F.col("c"), F.col("key"))).alias("dominant_other"))
    order = Window.partitionBy("thread_id").orderBy("pos")
    t = F.when(F.col("ticket"), F.col("pos"))
    behind, ahead = F.col("pos") - F.last(t, True).over(order), F.first(t, True).over(order.rowsBetween(0, Window.unboundedFollowing)) - F.col("pos")
    near = covered.withColumn("d", F.when(F.col("match"), F.least(F.coalesce(behind, ahead), F.coalesce(ahead, behind)))).groupBy("thread_id").agg(F.min("d").alias("d"))
    exclusive = (F.col("subject_mentions") > 0) & (F.col("other_mentions") == 0)
    out = by.join(dominant, "thread_id", "left").join(near, "thread_id", "left").withColumns(
        {
            "density": F.round(F.col("window_posts") / F.col("posts"), 2),
            "exclusive": exclusive,
            "dominated": (F.col("subject_mentions") > 0) & ~F.col("root_anchored") & ~exclusive & (F.col("posts") >= 8) & (F.col("other_mentions") >= 2 * F.col("subject_mentions")),
            # A ticket hit is at distance 0 of itself.
            "nearest": F.when(F.col("subject_mentions") > 0, 0),
            "nearest_match": F.col("d"),
        }
    )
    neighbour = F.when(exclusive | F.col("root_anchored"), False).when(F.col("dominated") | (F.col("subject_mentions") == 0), True).otherwise(F.col("density") < 0.5)
    return out.withColumn("historical_neighbour", neighbour).drop("d")


def segments(covered: DataFrame, merge_gap: int = 2, hydrate: int = 10) -> DataFrame:
    """(thread_id, segment, start_id, end_id, posts, reason): windows and the gaps between them, in order."""
    order = Window.partitionBy("thread_id").orderBy("pos")
    c = F.col("kind").isNotNull()
    seen, follow = F.last(F.when(c, F.col("pos")), True).over(order), F.first(F.when(c, F.col("pos")), True).over(order.rowsBetween(0, Window.unboundedFollowing))
    inside = c | _flag(follow - seen - 1 <= merge_gap)
    rows = covered.withColumns({"inside": inside, "any_before": seen.isNotNull(), "any_after": follow.isNotNull()})
    new = F.coalesce((F.col("inside") != F.lag("inside").over(order)).cast("int"), F.lit(0))
    rows = rows.withColumn("segment", F.sum(new).over(order))
    by = rows.groupBy("thread_id", "segment").agg(
        F.min_by("id", "pos").alias("start_id"), F.max_by("id", "pos").alias("end_id"), F.count(F.lit(1)).alias("posts"), F.bool_or("inside").alias("inside"),
        F.bool_or(F.col("kind") == "ticket").alias("ticket"), F.bool_and("any_before").alias("before"), F.bool_and("any_after").alias("after"),
    )
    gap = F.when(F.col("before") & F.col("after") & (F.col("posts") >= hydrate), "omitted_gap").otherwise("off_topic_gap")
    return by.select("thread_id", "segment", "start_id", "end_id", "posts", F.when(F.col("inside"), F.when(_flag(F.col("ticket")), "ticket_window").otherwise("match_window")).otherwise(gap).alias("reason"))


# --- probes -----------------------------------------------------------------------------


def _positions(tokens: str, wanted: str) -> Column:
    return F.array_compact(F.transform(tokens, lambda t, i: F.when(t == wanted, i)))


def shortest_window(positions: Column) -> Column:
    """The shortest span that holds a position of each list, null if any list is empty. positions: array of ascending arrays."""
    last = lambda r: F.transform(positions, lambda ps: F.array_max(F.filter(ps, lambda p: p <= r)))
    spans = F.transform(F.flatten(positions), lambda r: F.when(F.forall(last(r), lambda x: x.isNotNull()), r - F.array_min(last(r)) + 1))
    return F.when(F.forall(positions, lambda ps: F.size(ps) > 0), F.array_min(spans))


def post_evidence(posts: DataFrame, probes: list[Probe]) -> DataFrame:
    """(thread_id, id, root, probe, phrase, exact, morph, exact_window, morph_window): what each post shows of each probe.

    exact and morph are arrays of term numbers. Windows are taken over the first 512 tokens.
    """
    toks = F.slice(T.tokens(F.translate("message", "Ёё", "Ее")), 1, MOST_TOKENS)
    p = posts.select("thread_id", "id", "create_at", "update_at", "delete_at", (F.col("id") == F.col("thread_id")).alias("root"), "message", _norm(F.col("message")).alias("norm"), toks.alias("toks"))
    russian = any(stems.token_stem(t) != t for probe in probes for t in probe.terms)
    p = p.withColumn("stems", F.slice(stems.stems(F.translate("message", "Ёё", "Ее")), 1, MOST_TOKENS) if russian else F.col("toks"))
    held = []
    for i, probe in enumerate(probes):
        terms = probe.terms[:MOST_TERMS]
        phrases = probe.phrases or (probe.value,)
        exact = [T.contains_exact(F.col("norm"), t) for t in terms]
        at = F.array(*[_positions("toks", t) for t in terms]) if terms else F.array().cast("array<array<int>>")
        morph = F.array(*[F.array_distinct(F.concat(_positions("toks", t), _positions("stems", stems.token_stem(t)))) for t in terms]) if russian and terms else at
        held.append(
            F.struct(
                F.lit(i).alias("probe"), _any([T.contains_exact(F.col("norm"), x.lower()) for x in phrases]).alias("phrase"),
                F.array_compact(F.array(*[F.when(e, j) for j, e in enumerate(exact)])).cast("array<int>").alias("said"),
                F.array_compact(F.transform(at, lambda ps, j: F.when(F.size(ps) > 0, j))).alias("exact"), F.array_compact(F.transform(morph, lambda ps, j: F.when(F.size(ps) > 0, j))).alias("morph"),
                shortest_window(at).alias("exact_window"), shortest_window(morph).alias("morph_window"),
            )
        )
    return p.select("thread_id", "id", "root", "create_at", "update_at", "delete_at", F.explode(F.array(*held)).alias("e")).select("thread_id", "id", "root", "create_at", "update_at", "delete_at", "e.*")


def probe_evidence(shown: DataFrame, probes: list[Probe]) -> DataFrame:
    """(thread_id, probe and its evidence over the thread's posts)."""
    number = lambda of: F.element_at(F.array(*[F.lit(of(p)) for p in probes]), F.col("probe") + 1)
    union = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    by = shown.groupBy("thread_id", "probe").agg(
        F.bool_or(F.col("phrase") & F.col("root")).alias("phrase_in_root"), F.bool_or(F.col("phrase") & ~F.col("root")).alias("phrase_in_reply"),
        F.size(union("said")).alias("exact_terms"), F.size(F.array_union(union("said"), union("morph"))).alias("matched_terms"),
        F.max(F.size("exact")).alias("exact_same_post"), F.max(F.size("morph")).alias("morph_same_post"), F.size(union("morph")).alias("across"),
        F.size(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("root"), F.col("morph")))))).alias("in_root"), F.min("exact_window").alias("exact_window"), F.min("morph_window").alias("window"),
    ).withColumns({"terms": number(lambda p: len(p.terms)), "near_terms": number(lambda p: min(len(p.terms), MOST_TERMS))})
    phrase, k = F.col("phrase_in_root") | F.col("phrase_in_reply"), F.col("near_terms")
    kind = (
        F.when(F.col("exact_window") <= NEAR, "exact_terms_near")
        .when(F.col("window") <= NEAR, "morph_terms_near")
        .when(F.col("exact_same_post") == k, "exact_terms_same_post")
        .when(F.col("morph_same_post") == k, "morph_terms_same_post")
        .when(F.col("across") == k, "terms_across_thread")
    )
    return by.withColumns(
        {
            "matched": phrase | (F.col("matched_terms") > 0),
            "exact_full": phrase | ((F.col("terms") > 0) & (F.col("exact_terms") == F.col("terms"))),
            "full": phrase | ((F.col("terms") > 0) & (F.col("matched_terms") == F.col("terms"))),
            "kind": F.when((F.col("terms") >= 2) & (F.col("terms") <= MOST_TERMS), kind),
        }
    )


def thread_evidence(posts: DataFrame, probes: list[Probe], subject: str | None) -> DataFrame:
    """One row for each thread: sums over probes, best proximity, depth, stubs and bulletins."""
    shown = post_evidence(posts, probes)
    tier = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("kind")), F.lit(0))
    by = probe_evidence(shown, probes).withColumn("tier", tier).groupBy("thread_id").agg(
        F.count_if("phrase_in_root").alias("phrases_in_root"), F.count_if("phrase_in_reply").alias("phrases_in_reply"), F.count_if("matched").alias("matched_probes"), F.count_if("full").alias("full_probes"),
        F.count_if("exact_full").alias("exact_full_probes"), F.sum("matched_terms").alias("matched_terms"), F.sum(F.col("matched_terms") - F.col("exact_terms")).alias("morph_terms"), F.min("window").alias("window"), F.max("tier").alias("tier"),
        F.max_by("kind", F.struct("tier", -F.col("probe"))).alias("kind"),
    )
    relevant = shown.where(F.col("phrase") | (F.size("said") > 0) | (F.size("morph") > 0)).groupBy("thread_id").agg(F.max(F.greatest("create_at", "update_at", "delete_at")).alias("latest_match_at"), F.count_distinct("id").alias("matching_posts"))
    words = F.regexp_extract_all(F.col("message"), F.lit(T.WORD), F.lit(0))
    root = F.col("id") == F.col("thread_id")
    base = posts.withColumns({"n_words": F.size(words), "root": root})
    if subject:
        clean = F.regexp_replace(F.regexp_replace("message", r"(?i)https?://\S+", " "), rf"(?i)\Q{subject}\E", " ")
        base = base.withColumns({"left": F.size(F.regexp_extract_all(clean, F.lit(T.WORD), F.lit(0))), "says": T.contains_exact(_norm(F.col("message")), subject.lower()), "keys": T.ticket_keys(F.col("message"))})
    else:
        base = base.withColumns({"left": F.lit(9), "says": F.lit(False), "keys": F.array().cast("array<string>")})
    depth = F.least(F.lit(5), F.count_if(F.col("n_words") >= 6))
    bulletin = (F.size("keys") >= 3) & F.array_contains("keys", (subject or "").upper())
    whole = base.groupBy("thread_id").agg(
        F.any_value("conversation_id").alias("conversation_id"), F.count(F.lit(1)).alias("posts_in_thread"), depth.alias("substantive"), F.sum("left").alias("residual"), F.max(F.greatest("create_at", "update_at", "delete_at")).alias("latest_activity_at"),
        F.bool_or(F.col("root") & F.col("says")).alias("root_says"), F.bool_or(~F.col("root") & F.col("says")).alias("reply_says"), F.bool_or(F.col("root") & bulletin).alias("bulletin_root"),
    )
    out = whole.join(by, "thread_id").join(relevant, "thread_id", "left")
    return out.withColumns(
        {
            "depth": F.when((F.col("phrases_in_root") > 0) & (F.col("substantive") >= 3), F.col("substantive")).otherwise(0),
            "thin_stub": F.lit(bool(subject)) & (F.col("substantive") < 3) & (F.col("residual") <= 4),
            "bulletin": F.col("bulletin_root") & ~F.col("reply_says"),
        }
    ).drop("bulletin_root", "residual")


def vectors(evidence: DataFrame, metrics: DataFrame | None, routed: DataFrame, fused: DataFrame, structured: DataFrame | None = None, explicit: DataFrame | None = None) -> DataFrame:
    """(thread_id, conversation_id, FULL_VECTOR, evidence and focus columns) of matching threads; metrics: of ticket_metrics() for a ticket subject.

    structured: (thread_id, n) entity matches; explicit: (thread_id) of explicit ticket links; routed: (id, weight, priority).
    """
    ticket = metrics is not None
    rows = evidence.join(routed.select(F.col("id").alias("conversation_id"), F.col("weight").alias("routing"), "priority"), "conversation_id").join(fused.select("thread_id", "fusion"), "thread_id", "left")
    if ticket:
        rows = rows.join(metrics.select("thread_id", "density", "root_anchored", "exclusive", "dominated", "nearest", "subject_mentions"), "thread_id", "left")
    else:
        rows = rows.selectExpr("*", "0D AS density", "false AS root_anchored", "false AS exclusive", "false AS dominated", "CAST(NULL AS INT) AS nearest", "0L AS subject_mentions")
    rows = rows.join(structured.select("thread_id", F.col("n").alias("structured")), "thread_id", "left") if structured is not None else rows.withColumn("structured", F.lit(0))
    rows = rows.join(explicit.select("thread_id").distinct().withColumn("linked", F.lit(True)), "thread_id", "left") if explicit is not None else rows.withColumn("linked", F.lit(False))
    rows = rows.withColumns({"fusion": F.coalesce("fusion", F.lit(0.0)), "structured": F.coalesce("structured", F.lit(0)), "linked": _flag(F.col("linked"))})
    c = F.col
    rows = rows.where((c("fusion") > 0) | (c("structured") > 0) | c("linked") | c("root_says") | c("reply_says"))
    low = c("thin_stub") | c("bulletin")
    focus = F.when(low | ~(c("root_says") | c("reply_says")) | c("dominated"), 0).when(c("root_anchored") | c("exclusive"), 3).when(c("density") >= 0.4, 2).otherwise(1) if ticket else F.lit(0)
    sparse = F.when(~low & ~c("root_anchored") & ~c("exclusive") & (c("posts_in_thread") >= 20) & (c("density") < 0.15), -2).otherwise(0) if ticket else F.lit(0)
    near = F.lit(0)
    if ticket:
        near = F.least(F.floor(c("density") * 10 + 0.5), F.greatest(F.lit(1), c("depth") + 1)) + F.when(c("root_anchored"), 2).otherwise(0) + F.when(c("root_says") | (c("nearest") == 0), 1).otherwise(0) - F.when(c("nearest") > 20, 1).otherwise(0)
        near = F.when(low | c("dominated"), 0).otherwise(near)
    one = lambda x: _flag(x).cast("int")
    full = {
        "direct": F.lit(0),
        "explicit_ticket": one(c("linked")),
        "ticket_in_root": one(c("root_says") & ~low),
        "ticket_in_reply": one(c("reply_says") | (c("root_says") & low)),
        "ticket_focus": focus,
        "subject_in_root": F.lit(0) if ticket else one(c("phrases_in_root") > 0),
        "phrase_in_root": F.when(low, 0).otherwise(c("phrases_in_root")),
        "full_coverage": c("exact_full_probes") + c("full_probes"),
        "proximity_tier": c("tier"),
        "proximity_window": F.when(c("tier") >= 3, MOST_TOKENS + 1 - c("window")).otherwise(0),
        "structured_matches": c("structured"),
        "thread_depth": F.when(c("bulletin"), -2).when(c("thin_stub"), -1).otherwise(c("depth") + near + sparse),
        "phrase_in_reply": c("phrases_in_reply") + F.when(low, c("phrases_in_root")).otherwise(0),
        "latest_match_at": F.coalesce("latest_match_at", F.lit(0)),
    }
    return rows.withColumns({k: v.cast("double") for k, v in full.items()}).withColumns({k: F.col(k).cast("double") for k in FULL_VECTOR})


def reasons(rows: DataFrame, routing_reason: Column | None = None) -> DataFrame:
    """rows of vectors() with reasons: why a thread is a candidate, in a fixed order."""
    c = F.col
    said = [
        ("explicit_ticket_relationship", c("linked")), ("ticket_in_root", c("root_says")), ("ticket_in_reply", c("reply_says")), ("structured_entity_match", c("structured") > 0), ("subject_in_root", c("subject_in_root") > 0),
        ("exact_phrase", (c("phrases_in_root") > 0) | (c("phrases_in_reply") > 0)), ("exact_phrase_in_root", c("phrases_in_root") > 0), ("exact_phrase_in_reply", c("phrases_in_reply") > 0),
        ("all_terms_in_thread", c("exact_full_probes") > 0), ("all_expanded_terms_in_thread", c("full_probes") > c("exact_full_probes")), *((k, c("kind") == k) for k in KINDS), ("morphology_match", c("morph_terms") > 0),
        ("multiple_probes_in_thread", c("matched_probes") > 1), ("substantive_thread_depth", c("depth") > 0), ("thin_thread", c("thin_stub")), ("multi_ticket_root", c("bulletin")), ("rank_fusion", c("fusion") > 0),
    ]
    parts = [F.when(_flag(cond), F.lit(name)) for name, cond in said]
    parts.append(F.concat(F.lit("routing_"), routing_reason) if routing_reason is not None else F.lit(None).cast("string"))
    parts += [F.when(c("priority") > 0, "conversation_priority"), F.lit("latest_activity")]
    return rows.withColumn("reasons", F.array_compact(F.array(*parts)))
