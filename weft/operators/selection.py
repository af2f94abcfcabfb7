"""Choice among candidate threads and judgement of a packet, request by request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.brief import PRIORITY

# Reasons that speak of the subject, and reasons of any content match.
SUBJECT_REASONS = ["direct_post", "explicit_ticket_relationship", "ticket_in_root", "ticket_in_reply", "structured_entity_match", "subject_in_root", "exact_phrase", "exact_phrase_in_root", "exact_phrase_in_reply", "all_terms_in_thread"]
MATCH_REASONS = [
    "direct_post", "remote_search", "structured_entity_match", "subject_in_root", "exact_phrase", "exact_phrase_in_root", "exact_phrase_in_reply", "all_terms_in_thread", "all_expanded_terms_in_thread", "exact_terms_near", "morph_terms_near",
    "exact_terms_same_post", "morph_terms_same_post", "expanded_terms_same_post", "terms_across_thread", "morphology_match", "concept_match", "keyboard_layout_match", "transliteration_match", "mixed_script_match", "prefix_match", "typo_match",
    "query_expansion", "multiple_probes_in_thread",
]
TICKET_REASONS = ["ticket_in_root", "ticket_in_reply", "explicit_ticket_relationship"]
FULL_RATIO, FULL_SKIP = 0.25, 5


def _has(reasons: str, names: list[str]) -> Column:
    return F.arrays_overlap(F.col(reasons), F.array(*[F.lit(n) for n in names]))


def pinned(reasons: str = "reasons") -> Column:
    """Whether a candidate of a ticket request is kept whatever the probes say."""
    return _has(reasons, SUBJECT_REASONS)


def drop_reasons(candidates: DataFrame) -> DataFrame:
    """candidates (request, thread_id, ord, reasons, selected, no_match, unavailable) with drop_reason and actionable, for those not selected."""
    why = F.when(F.col("unavailable"), "unavailable").when(F.col("no_match"), "no_match").when(F.array_contains("reasons", "thin_thread"), "thin").otherwise("budget")
    gone = candidates.where(~F.col("selected")).withColumn("drop_reason", why)
    return gone.withColumn("actionable", (F.col("drop_reason") == "thin") | _has("reasons", TICKET_REASONS))


def dropped(candidates: DataFrame, most: int = 5) -> DataFrame:
    """(request, thread_id, drop_reason, place): what was left out and may matter: actionable first, thin first."""
    rows = drop_reasons(candidates).where(F.col("actionable") | _has("reasons", MATCH_REASONS))
    w = Window.partitionBy("request").orderBy(F.desc(F.col("actionable").cast("int")), (F.col("drop_reason") != "thin").cast("int"), "ord")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("request", "thread_id", "drop_reason", "place")


def counters(candidates: DataFrame) -> DataFrame:
    """Counts of each request: candidates, returned, dropped as thin, for lack of room (with the subject or not), without match."""
    budget = ~F.col("selected") & ~F.col("no_match") & ~F.col("unavailable")
    return candidates.groupBy("request").agg(
        F.count(F.lit(1)).alias("candidate_threads"), F.count_if("selected").alias("returned_threads"), F.count_if(~F.col("selected") & F.array_contains("reasons", "thin_thread")).alias("dropped_thin"),
        F.count_if(budget).alias("dropped_by_budget"), F.count_if(budget & _has("reasons", SUBJECT_REASONS)).alias("dropped_subject"), F.count_if(~F.col("selected") & F.col("no_match")).alias("dropped_no_match"),
    )


def primary_score() -> Column:
    """How well a packed thread serves as the first to read."""
    c = F.col
    thin = _has("reasons", ["thin_thread", "multi_ticket_root"])
    focus = F.when(c("root_anchored"), 50).otherwise(0) + F.when(c("exclusive"), 40).otherwise(0) - F.when(c("dominated"), 80).otherwise(0) + F.floor(F.coalesce(c("density"), F.lit(0)) * 10 + 0.5)
    return F.when(thin, -100).otherwise(0) + focus + F.when(_has("reasons", ["substantive_thread_depth"]), 20).otherwise(0) + F.least(c("total_posts"), F.lit(12)) - c("omitted_posts") * 0.01


def primary_threads(packet: DataFrame) -> DataFrame:
    """(request, primary): the thread of the best score, the first in rank of equals."""
    return packet.groupBy("request").agg(F.max_by("thread_id", F.struct(F.round(primary_score(), 4), -F.col("rank"))).alias("primary"))


def recommends_full() -> Column:
    return (F.col("omitted_posts") > 0) & ((F.col("omitted_posts") / F.col("total_posts") >= FULL_RATIO) | (F.col("largest_skip") >= FULL_SKIP))


def truncated(packet: DataFrame) -> DataFrame:
    """(request, thread_id, place): threads worth reading in full: the primary one, then by widest skip and share left out."""
    rows = packet.join(primary_threads(packet), "request").where(recommends_full())
    w = Window.partitionBy("request").orderBy((F.col("thread_id") != F.col("primary")).cast("int"), F.desc("largest_skip"), F.desc(F.col("omitted_posts") / F.col("total_posts")), "thread_id")
    return rows.select("request", "thread_id", F.row_number().over(w).alias("place"))


def status(packet: DataFrame, fresh: DataFrame, counts: DataFrame, mode: str = "network", local_fallback: bool = False, remote_performed: bool = False, remote_failures: int = 0) -> DataFrame:
    """One row for each request: how adequate, current and complete its packet is, and what it may have missed.

    packet: (request, thread_id, rank, reasons, total_posts, omitted_posts, largest_skip, pending); fresh: (request, stale, complete) of each conversation; counts: of counters().
    """
    by = packet.groupBy("request").agg(
        F.count(F.lit(1)).alias("threads"), F.bool_and(F.array_contains("reasons", "thin_thread")).alias("only_thin"), F.bool_or(recommends_full()).alias("cut"), F.bool_or("pending").alias("pending"),
        F.sum("omitted_posts").alias("omitted_posts"), F.max("largest_skip").alias("largest_skip"),
    )
    age = fresh.groupBy("request").agg(F.count_if("stale").alias("stale_routed"), F.count_if(~F.col("complete")).alias("cutoffs"))
    rows = age.join(by, "request", "left").join(counts, "request", "left")
    c, no = F.col, F.lit(False)
    adequacy = F.when(c("threads").isNull(), "insufficient").when(c("only_thin"), "thin").otherwise("usable")
    local, clean = F.lit(mode == "local"), F.lit(remote_performed and not remote_failures)
    currency = F.when(local, "local_only").when(F.lit(local_fallback or remote_failures > 0) | (c("stale_routed") > 0), "possibly_stale").otherwise("current")
    discovery = F.when(local, "local_only").when((c("stale_routed") == 0) | clean, "current").otherwise("possibly_stale")
    selected = F.when(c("threads").isNull(), "not_applicable").when(c("cut"), "truncated").otherwise("complete")
    rows = rows.withColumns({"adequacy": adequacy, "currency": currency, "discovery": discovery, "selected_threads": selected, "selection": F.when(F.coalesce("dropped_by_budget", F.lit(0)) > 0, "budget_bounded").otherwise("complete"), "index_history": F.when(c("cutoffs") > 0, "cutoff_bounded").otherwise("full")})
    answers = (c("adequacy") == "usable") & (c("selected_threads") == "complete") & ~F.coalesce("pending", no)
    rows = rows.withColumn("can_answer", answers)
    missed = F.when(F.coalesce("dropped_subject", F.lit(0)) > 0, "subject_matched_budget_drops").when(c("discovery") == "local_only", "local_discovery").when(c("discovery") == "possibly_stale", "stale_discovery")
    missed = missed.when((c("index_history") == "cutoff_bounded") & ~(c("can_answer") & (c("currency") == "current")), "index_cutoff")
    return rows.withColumns({"missed_reason": missed, "may_be_stale": c("currency") != "current"}).select("request", "adequacy", "currency", "discovery", "selected_threads", "selection", "index_history", "can_answer", "missed_reason", "may_be_stale", "omitted_posts", "largest_skip")


def next_actions(status: DataFrame, full: DataFrame, drops: DataFrame) -> DataFrame:
    """(request, actions): ordered steps that answer what a status leaves open, each as action:priority."""
    f = full.where("place = 1").select("request", F.lit(True).alias("has_full"))
    d = drops.groupBy("request").agg(F.bool_or(F.col("drop_reason") == "thin").alias("thin"), F.bool_or(F.col("drop_reason") == "budget").alias("budget"))
    rows = status.join(f, "request", "left").join(d, "request", "left")
    c = F.col
    on = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), name)
    steps = [
        on(c("has_full"), "thread_full:recommended"), on(c("may_be_stale") & (c("currency") != "local_only"), "fresh_or_remote:recommended"), on(c("currency") == "local_only", "fresh_or_remote:optional"),
        on(c("missed_reason") == "index_cutoff", "sync:optional"), on(c("thin"), "inspect_dropped:optional"), on(c("budget") & (c("missed_reason") == "subject_matched_budget_drops"), "review_candidates:recommended"), on(c("adequacy") == "insufficient", "widen:recommended"),
    ]
    return rows.select("request", F.array_compact(F.array(*steps)).alias("actions"))


def merged_decisions(decisions: DataFrame, most: int = 5) -> DataFrame:
    """(request, id, place): decisions of all threads by settledness, then newest."""
    w = Window.partitionBy("request").orderBy(F.array_position(F.array(*[F.lit(k) for k in PRIORITY]), F.col("decision_kind")), F.desc("create_at"), "id")
    return decisions.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("request", "thread_id", "id", "decision_kind", "place")


def merged_questions(questions: DataFrame, most: int = 3) -> DataFrame:
    """(request, id, place): every unanswered question, others as far as there is room."""
    open_ = F.col("resolution").isin("unanswered", "unknown") & (F.col("question_kind") == "question")
    w = Window.partitionBy("request").orderBy(F.desc(open_.cast("int")), F.desc(F.col("is_tail").cast("int")), (F.col("question_kind") == "follow_up").cast("int"), "replies_after", F.desc("create_at"), "id")
    rows = questions.withColumns({"open": open_, "place": F.row_number().over(w)})
    return rows.where(F.col("open") | (F.col("place") <= most)).select("request", "thread_id", "id", "open", "place")


def summary(decisions: DataFrame, questions: DataFrame) -> DataFrame:
    """(request, counts of decisions by kind, unresolved questions)."""
    made = decisions.groupBy("request").pivot("decision_kind", PRIORITY).agg(F.count(F.lit(1)))
    asked = questions.groupBy("request").agg(F.count_if(F.col("resolution").isin("unanswered", "unknown") & (F.col("question_kind") == "question")).alias("unresolved"))
    return made.join(asked, "request", "full").na.fill(0)


def latest_attachments(posts: DataFrame, files: DataFrame, layer: DataFrame, names: list[str]) -> DataFrame:
    """(request, thread_id, post_id, file_id, files): of posts of the decision layer (request, thread_id, id) the latest with a live file of these extensions."""
    ext = F.lower(F.element_at(F.split("name", r"\."), -1))
    held = files.where((F.col("delete_at") == 0) & F.col("name").contains(".") & ext.isin(names)).groupBy("post_id").agg(F.count(F.lit(1)).alias("files"), F.min(F.col("id")).alias("file_id"))
    rows = layer.select("request", "id").distinct().join(posts.where("delete_at = 0").select("id", "thread_id", "create_at"), "id").join(held.withColumnRenamed("post_id", "id"), "id")
    # The latest; of equal times the smaller id.
    w = Window.partitionBy("request").orderBy(F.desc("create_at"), "id")
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").select("request", "thread_id", F.col("id").alias("post_id"), "file_id", "files")


def skip_reasons(omitted: DataFrame) -> DataFrame:
    """(thread_id, run, skipped, reason): omitted: (thread_id, run, id, in_window, in_gap) of posts left out, by run of neighbours."""
    by = omitted.groupBy("thread_id", "run").agg(F.count(F.lit(1)).alias("skipped"), F.bool_or("in_gap").alias("gap"), F.bool_or("in_window").alias("inside"))
    return by.select("thread_id", "run", "skipped", F.when(F.col("gap"), "omitted_gap").when(~F.col("inside"), "outside_ticket_window").otherwise("budget").alias("reason"))
