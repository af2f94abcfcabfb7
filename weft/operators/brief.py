"""Decisions, questions, roles and the brief of each thread.

posts have (id, thread_id, user_id, create_at, delete_at, message). Everything is windows
and aggregates by thread; no operator pairs all posts of a thread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import cues as C
from weft.functions import text as T

FLOOR, ACK_BONUS, MOST_SPANS = 0.5, 0.15, 12
PRIORITY = ["approved_decision", "discussion_outcome", "implementation_intent", "proposal"]
PURPOSES = ["decision", "open_question", "debugging", "announce", "status", "noise"]
LOOK = 6


def _order():
    return Window.partitionBy("thread_id").orderBy("create_at", "id")


def _choice(of: Column, values: list[str]) -> Column:
    """The place of a value in a list."""
    return F.array_position(F.array(*[F.lit(v) for v in values]), of)


def read(posts: DataFrame) -> DataFrame:
    """Live posts with a text, with pos, ready (prepared text), and the cues of decisions, rejections, questions and refinements."""
    said = posts.where((F.col("delete_at") == 0) & F.col("message").rlike(r"\S")).withColumn("ready", C.prepared(F.col("message")))
    r = F.col("ready")
    return said.withColumns(
        {
            "pos": F.row_number().over(_order()),
            "decision": F.when(C.is_meta(r), F.array().cast("array<struct<rank:int,minus:double,cue:string,family:string,note:string,exact:boolean,key:string>>")).otherwise(C.matched(r, C.DECISION, asks=True, negated=True)),
            "rejected": C.matched(r, C.FAMILIES["rejected"]),
            "question": C.matched(r, C.FAMILIES["open_question"]),
            "scope": C.matched(r, C.FAMILIES["scope_refinement"], asks=True),
            "ack": C.ack_token(F.col("message")),
        }
    )


def acknowledgements(said: DataFrame) -> DataFrame:
    """(id, ack_id, affirming): of each post the first acknowledgement among the next two posts by others.

    Posts are gathered into runs of one author: the next two posts by others stand in the
    three runs that follow, as the third is not by the second's author.
    """
    rows = said.select("thread_id", "id", "user_id", "create_at", "ack")
    change = F.coalesce((F.lag("user_id").over(_order()) != F.col("user_id")).cast("int"), F.lit(1))
    rows = rows.withColumn("run", F.sum(change).over(_order()))
    first = F.row_number().over(Window.partitionBy("thread_id", "run").orderBy("create_at", "id"))
    runs = rows.withColumn("nth", first).groupBy("thread_id", "run").agg(
        F.first("user_id").alias("author"),
        F.max(F.when(F.col("nth") == 1, F.struct("id", "ack"))).alias("one"),
        F.max(F.when(F.col("nth") == 2, F.struct("id", "ack"))).alias("two"),
    )
    w = Window.partitionBy("thread_id").orderBy("run")
    ahead = lambda c, k: F.lead(c, k).over(w)
    other = F.when(ahead("author", 2) != F.col("author"), ahead("one", 2)).otherwise(ahead("one", 3))
    runs = runs.select("thread_id", "run", ahead("one", 1).alias("a"), F.coalesce(ahead("two", 1), other).alias("b"))
    hit = F.when(F.col("a.ack").isNotNull(), F.col("a")).when(F.col("b.ack").isNotNull(), F.col("b"))
    found = runs.select("thread_id", "run", hit.alias("hit")).where("hit IS NOT NULL")
    return rows.join(found, ["thread_id", "run"]).select("id", F.col("hit.id").alias("ack_id"), F.col("hit.ack").isin(C.AFFIRMING).alias("affirming"))


def candidate_spans(said: DataFrame, most: int | None = MOST_SPANS) -> DataFrame:
    """(thread_id, id, kind, cues, confidence, decision_kind, question_kind, ack_id): the best spans of each thread, agreements first."""
    acks = acknowledgements(said)
    rows = said.join(acks, "id", "left")
    base = ["thread_id", "id", "user_id", "create_at", "pos", "message"]
    none = F.lit(None).cast("string")
    plain = C.confidence(F.col("decision"))
    decided = rows.where(F.size("decision") > 0).select(
        *base, F.lit("decision_candidate").alias("kind"), F.col("decision").alias("hit"), F.when(F.col("ack_id").isNotNull(), F.round(F.least(F.lit(0.95), plain + ACK_BONUS), 2)).otherwise(plain).alias("confidence"),
        C.decision_kind(F.col("ready"), F.col("decision"), F.coalesce("affirming", F.lit(False))).alias("decision_kind"), none.alias("question_kind"), "ack_id",
    )
    rejected = rows.where(F.size("rejected") > 0).select(*base, F.lit("rejected_option_candidate").alias("kind"), F.col("rejected").alias("hit"), C.confidence(F.col("rejected")).alias("confidence"), none.alias("decision_kind"), none.alias("question_kind"), none.alias("ack_id"))
    asked = rows.where(F.size("question") > 0).select(*base, F.lit("open_question_candidate").alias("kind"), F.col("question").alias("hit"), C.confidence(F.col("question")).alias("confidence"), none.alias("decision_kind"), C.question_kind(F.col("message"), F.col("question")).alias("question_kind"), none.alias("ack_id"))
    spans = decided.unionByName(rejected).unionByName(asked).withColumn("cues", C.names(F.col("hit"))).drop("hit")
    if most is None:
        return spans
    w = Window.partitionBy("thread_id").orderBy(F.coalesce((F.col("decision_kind") != "approved_decision").cast("int"), F.lit(1)), F.desc("confidence"), "id", "kind")
    return spans.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def brief_decisions(spans: DataFrame, most: int = 5) -> DataFrame:
    """Decisions of each thread by settledness, then confidence."""
    strong = spans.where((F.col("kind") == "decision_candidate") & (F.col("confidence") >= FLOOR)).drop("place")
    w = Window.partitionBy("thread_id").orderBy(_choice(F.col("decision_kind"), PRIORITY), F.desc("confidence"), "id")
    return strong.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def antecedents(said: DataFrame, decisions: DataFrame, most: int = 2) -> DataFrame:
    """(decision_id, id, back): proposals and intents among the six posts before a short agreement or outcome, nearest first."""
    floated = C.decision_kind(F.col("ready"), _own(F.col("decision")), F.lit(False)).isin("proposal", "implementation_intent")
    w = _order().rowsBetween(-LOOK, -1)
    marked = said.withColumn("before", F.collect_list(F.when((F.size(_own(F.col("decision"))) > 0) & floated, F.struct("pos", "id"))).over(w))
    short = decisions.where(F.col("decision_kind").isin("approved_decision", "discussion_outcome") & (F.length(T.excerpt(F.col("message"))) <= 80)).select(F.col("id").alias("decision_id"))
    own = marked.join(short, marked["id"] == short["decision_id"], "left_semi").select(F.col("id").alias("decision_id"), F.posexplode(F.slice(F.reverse("before"), 1, most)).alias("back", "p"))
    return own.select("decision_id", F.col("p.id").alias("id"), (F.col("back") + 1).cast("int").alias("back"))


def _own(hit: Column) -> Column:
    """Decision cues alone, without approaches."""
    return F.filter(hit, lambda c: c["family"] == "decision")


def refinements(said: DataFrame, decisions: DataFrame, most: int = 2) -> DataFrame:
    """(decision_id, id, nth): posts that narrow a decision among the next six, before the next post that looks like a decision."""
    w = _order().rowsBetween(1, LOOK)
    ahead = said.withColumn("after", F.collect_list(F.struct("pos", "id", (F.size("decision") > 0).alias("stop"), (F.size("scope") > 0).alias("hit"))).over(w))
    stop = F.coalesce(F.array_min(F.transform(F.filter("after", lambda p: p["stop"]), lambda p: p["pos"])), F.lit(1 << 30))
    ahead = ahead.withColumn("stop_at", stop)
    kept = F.slice(F.filter("after", lambda p: p["hit"] & (p["pos"] < F.col("stop_at"))), 1, most)
    own = ahead.join(decisions.select("id"), "id", "left_semi").select(F.col("id").alias("decision_id"), F.posexplode(kept).alias("nth", "p"))
    return own.select("decision_id", F.col("p.id").alias("id"), (F.col("nth") + 1).cast("int").alias("nth"))


def open_questions(said: DataFrame, spans: DataFrame, decisions: DataFrame, subject: str | None, complete: bool = True, most: int = 3) -> DataFrame:
    """(thread_id, id, question_kind, confidence, replies_after, is_tail, resolution, responders, place).

    A bare question mark counts only in an asking post that names the subject. Posts shown as decisions are left out.
    """
    asked = spans.where((F.col("kind") == "open_question_candidate") & (F.col("confidence") >= 0.4)).join(decisions.select("id"), "id", "left_anti")
    bare = (F.size("cues") == 1) & (F.get("cues", F.lit(0)) == "?")
    named = F.array_contains(T.ticket_keys(F.col("message")), subject.upper()) if subject else F.lit(False)
    asked = asked.where(~bare | (C.is_asked(F.col("message")) & named))
    by_user = Window.partitionBy("thread_id", "user_id").orderBy("create_at", "id")
    after = F.count(F.lit(1)).over(_order().rowsBetween(1, Window.unboundedFollowing)) - F.count(F.lit(1)).over(by_user.rowsBetween(1, Window.unboundedFollowing))
    placed = said.select("id", "pos", "thread_id", "user_id", "create_at", after.alias("replies_after"), (F.row_number().over(Window.partitionBy("thread_id").orderBy(F.desc("create_at"), F.desc("id"))) == 1).alias("last"))
    rows = asked.select("thread_id", "id", "create_at", "question_kind", "confidence", "cues").join(placed.select("id", "replies_after", "last"), "id")
    tail = F.col("last") if complete else F.lit(False)
    resolution = F.when(F.col("question_kind") != "question", "unknown").when(F.col("replies_after") > 0, "possibly_answered").when(tail, "unanswered").otherwise("unknown")
    w = Window.partitionBy("thread_id").orderBy(F.desc(tail.cast("int")), (F.col("question_kind") == "follow_up").cast("int"), "replies_after", F.desc("confidence"), F.desc("create_at"), "id")
    return rows.select("thread_id", "id", "create_at", "question_kind", "confidence", "cues", F.col("replies_after").cast("long").alias("replies_after"), tail.alias("is_tail"), resolution.alias("resolution"), F.row_number().over(w).alias("place")).where(F.col("place") <= most)


def role_hints(said: DataFrame) -> DataFrame:
    """(thread_id, label, evidence, cues, confidence): of each role the posts that show it and its strongest cues."""
    labels = [f for f in C.FAMILIES if f.startswith("role:")]
    found = F.array(*[F.struct(F.lit(f.removeprefix("role:")).alias("label"), C.top(C.matched(F.col("ready"), C.FAMILIES[f])).alias("hit")) for f in labels])
    rows = said.select("thread_id", "id", F.explode(F.filter(found, lambda x: F.size(x["hit"]) > 0)).alias("r")).select("thread_id", "id", "r.label", "r.hit")
    evidence = rows.groupBy("thread_id", "label").agg(F.array_sort(F.collect_set("id")).alias("evidence"))
    each = rows.select("thread_id", "label", F.explode("hit").alias("c")).groupBy("thread_id", "label", F.col("c.cue").alias("cue")).agg(F.min("c.minus").alias("minus"))
    best = each.groupBy("thread_id", "label").agg(F.slice(F.array_sort(F.collect_list(F.struct("minus", "cue"))), 1, C.MOST_CUES).alias("best"))
    return evidence.join(best, ["thread_id", "label"]).select("thread_id", "label", "evidence", F.transform("best", lambda b: b["cue"]).alias("cues"), T.confidence(F.transform("best", lambda b: -b["minus"])).alias("confidence"))


def late_acknowledgements(said: DataFrame, decisions: DataFrame, tail: int = 8) -> DataFrame:
    """(thread_id, decision_id, ack_id, confidence): an agreeing acknowledgement in the last posts for the strongest decision before it,
    more than two posts by others apart, if it is paired with none already.

    Both sides are bounded: eight last posts and the few decisions of a thread. Posts between are differences of running counts.
    """
    paired = decisions.where("ack_id IS NOT NULL").select(F.col("ack_id").alias("id"))
    back = F.row_number().over(Window.partitionBy("thread_id").orderBy(F.desc("create_at"), F.desc("id")))
    numbered = said.withColumns({"back": back, "own_pos": F.row_number().over(Window.partitionBy("thread_id", "user_id").orderBy("create_at", "id"))})
    acks = numbered.where((F.col("back") <= tail) & F.col("ack").isin(C.AFFIRMING)).join(paired, "id", "left_anti").select("thread_id", F.col("id").alias("ack_id"), F.col("user_id").alias("ack_user"), F.col("pos").alias("ack_pos"))
    made = decisions.select("thread_id", "id", "decision_kind", "confidence", "user_id", "pos").join(numbered.select("id", "own_pos"), "id")
    pairs = acks.join(made, "thread_id").where((F.col("pos") < F.col("ack_pos")) & (F.col("user_id") != F.col("ack_user")))
    # The decider's own posts before the acknowledgement, by the last one at or before it.
    own = numbered.select("thread_id", "user_id", F.col("pos").alias("p"), F.col("own_pos").alias("n"))
    tails = acks.select("thread_id", "ack_id", "ack_pos").join(made.select("thread_id", "user_id").distinct(), "thread_id")
    upto = tails.withColumn("p", F.col("ack_pos")).select("thread_id", "user_id", "p", "ack_id", F.lit(None).cast("int").alias("n")).unionByName(own.withColumn("ack_id", F.lit(None).cast("string")))
    w = Window.partitionBy("thread_id", "user_id").orderBy("p", F.col("ack_id").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = upto.withColumn("own_before", F.coalesce(F.max("n").over(w), F.lit(0))).where("ack_id IS NOT NULL").select("thread_id", "user_id", "ack_id", "own_before")
    between = F.col("ack_pos") - F.col("pos") - 1 - (F.col("own_before") - F.col("own_pos"))
    pairs = pairs.join(upto, ["thread_id", "user_id", "ack_id"]).where(between > 2)
    best = F.struct(_choice(F.col("decision_kind"), PRIORITY).alias("k"), (-F.col("confidence")).alias("c"), F.col("id").alias("decision_id"), (-F.col("ack_pos")).alias("a"))
    return pairs.groupBy("thread_id").agg(F.min_by(F.struct(F.col("id").alias("decision_id"), "ack_id", "confidence"), best).alias("b")).select("thread_id", "b.decision_id", "b.ack_id", F.round(F.least(F.lit(0.7), 0.45 + F.least(F.lit(0.15), F.col("b.confidence") * 0.2)), 2).alias("confidence"))


def noise_threads(posts: DataFrame, subject: str | None = None) -> DataFrame:
    """(thread_id): threads of at most three live short posts that name the subject (or any ticket) and, with a subject, no other ticket."""
    keys = T.ticket_keys(F.col("message"))
    live = posts.where("delete_at = 0").withColumns({"keys": keys, "said": F.trim("message")})
    own = F.array_contains("keys", subject.upper()) if subject else F.size("keys") > 0
    other = F.size(F.array_remove("keys", subject.upper())) > 0 if subject else F.lit(False)
    by = live.groupBy("thread_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("said")).alias("longest"), F.count_if(own).alias("named"), F.count_if(other).alias("others"))
    return by.where("n <= 3 AND longest <= 160 AND named > 0 AND others = 0").select("thread_id")


def capped_evidence(rows: DataFrame, label: list[str], most: int = 5) -> DataFrame:
    """The last few posts of each label in the order of the thread: rows (label columns, create_at, id)."""
    return rows.groupBy(*label).agg(F.array_sort(F.collect_set(F.struct("create_at", "id"))).alias("e")).select(*label, F.transform(F.slice("e", F.greatest(F.size("e") - (most - 1), F.lit(1)), most), lambda x: x["id"]).alias("evidence"))


def purpose_hints(posts: DataFrame, said: DataFrame, spans: DataFrame, decisions: DataFrame, questions: DataFrame, roles: DataFrame, subject: str | None, announced: DataFrame | None = None, most: int = 3) -> DataFrame:
    """(thread_id, label, confidence, place): what each thread is for, by the order of labels."""
    one = lambda df, label, c: df.select("thread_id", F.lit(label).alias("label"), c.alias("confidence"))
    decided = one(decisions.groupBy("thread_id").agg(F.max("confidence").alias("c")), "decision", F.col("c"))
    bare = (F.size("cues") == 1) & (F.get("cues", F.lit(0)) == "?")
    named = F.array_contains(T.ticket_keys(F.col("message")), subject.upper()) if subject else F.lit(False)
    asked = spans.where((F.col("kind") == "open_question_candidate") & (~bare | (C.is_asked(F.col("message")) & named)))
    asked = asked.groupBy("thread_id").agg(F.max("confidence").alias("c"), F.countDistinct("id").alias("n"))
    tails = questions.where("is_tail").select("thread_id", F.lit(True).alias("tail")).distinct()
    asked = asked.join(tails, "thread_id", "full").withColumn("c", F.coalesce("c", F.lit(0.0))).where("c >= 0.5 OR n >= 3 OR tail")
    asked = one(asked, "open_question", F.when(F.col("tail"), F.greatest("c", F.lit(0.55))).otherwise(F.col("c")))
    debugging = one(roles.where(F.col("label").isin("testing", "regression", "implementation")).groupBy("thread_id").agg(F.max("confidence").alias("c")), "debugging", F.col("c"))
    status = one(roles.where("label = 'coordination'").join(decisions.select("thread_id").distinct(), "thread_id", "left_anti"), "status", F.col("confidence"))
    hints = decided.unionByName(asked).unionByName(debugging).unionByName(status)
    if announced is not None:
        hints = hints.unionByName(one(announced.select("thread_id").distinct(), "announce", F.lit(0.7)))
    noise = one(noise_threads(posts, subject).join(hints.select("thread_id").distinct(), "thread_id", "left_anti"), "noise", F.lit(0.6))
    w = Window.partitionBy("thread_id").orderBy(_choice(F.col("label"), PURPOSES), F.desc("confidence"))
    return hints.unionByName(noise).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def retained_posts(posts: DataFrame, files: DataFrame, decisions: DataFrame, narrowed: DataFrame, questions: DataFrame, responses: DataFrame, outcome: DataFrame) -> DataFrame:
    """(thread_id, id): posts that a brief keeps: decisions with their acknowledgements and refinements, questions with responses,
    the outcome, posts with live files; of a thread with none of these the latest post."""
    ids = [decisions.select("id"), decisions.select(F.col("ack_id").alias("id")).where("id IS NOT NULL"), narrowed.select("id"), questions.select("id"), responses.select("id"), outcome.select("id")]
    live = posts.where("delete_at = 0")
    ids.append(live.join(files.where("delete_at = 0").select(F.col("post_id").alias("id")), "id", "left_semi").select("id"))
    every = ids[0]
    for more in ids[1:]:
        every = every.unionByName(more)
    kept = posts.join(every.distinct(), "id", "left_semi").select("thread_id", "id")
    latest = posts.groupBy("thread_id").agg(F.max_by("id", F.struct("create_at", "id")).alias("id")).join(kept.select("thread_id").distinct(), "thread_id", "left_anti")
    return kept.unionByName(latest)


def responses(said: DataFrame, questions: DataFrame, most: int = 3) -> DataFrame:
    """(question_id, id, nth): the first posts by others after each question of a brief."""
    q = questions.join(said.select("id", "pos", "user_id"), "id").select("thread_id", F.col("id").alias("question_id"), F.col("pos").alias("q_pos"), F.col("user_id").alias("q_user"))
    later = said.select("thread_id", "id", "pos", "user_id").join(q, "thread_id").where((F.col("pos") > F.col("q_pos")) & (F.col("user_id") != F.col("q_user")))
    w = Window.partitionBy("question_id").orderBy("pos")
    return later.select("question_id", "id", F.row_number().over(w).alias("nth")).where(F.col("nth") <= most)


def cited_posts(spans: DataFrame, roles: DataFrame) -> DataFrame:
    """(thread_id, id): every post that spans, acknowledgements and roles name."""
    a = spans.select("thread_id", F.explode(F.array_compact(F.array("id", "ack_id"))).alias("id"))
    return a.unionByName(roles.select("thread_id", F.explode("evidence").alias("id"))).distinct()


def cue_stages(said: DataFrame) -> DataFrame:
    """(family, cue, matched, guard_rejected, reported): distinct posts of each decision cue by what became of it."""
    every = C.matched(F.col("ready"), C.DECISION)
    kept = C.matched(F.col("ready"), C.DECISION, asks=True, negated=True)
    rows = said.select("id", F.explode(every).alias("c"), F.transform(kept, lambda c: c["cue"]).alias("kept"), F.transform(C.top(kept), lambda c: c["cue"]).alias("top"))
    n = lambda c: F.count_distinct(F.when(c, F.col("id")))
    cue = F.col("c.cue")
    return rows.groupBy(F.col("c.family").alias("family"), cue.alias("cue")).agg(F.count_distinct("id").alias("matched"), n(~F.array_contains("kept", cue)).alias("guard_rejected"), n(F.array_contains("top", cue)).alias("reported"))
