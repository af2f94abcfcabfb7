"""Lookups by key, predicates on posts, and projections of rows; each is a filter, a join or a select."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import text as T

LIVE = "delete_at = 0"
# Extensions of data files and of workbooks that are not read; words that mark a failed end.
DATA_FILES = ["csv", "tsv", "xlsx", "xls", "ods", "json", "ndjson", "log", "sql", "txt"]
UNREAD_WORKBOOKS = ["xls", "ods"]
ERROR_CUES = ["ошибк", "упал", "завис", "не проход", "failed", "error"]


def by_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is among ids (id); no ids, no rows."""
    return rows.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_semi")


def scoped(posts: DataFrame, conversations: DataFrame) -> DataFrame:
    """Posts of these conversations (id); an empty scope gives nothing."""
    return posts.join(F.broadcast(conversations.select(F.col("id").alias("conversation_id")).distinct()), "conversation_id", "left_semi")


def file_owners(files: DataFrame, posts: DataFrame) -> DataFrame:
    """(file_id, post_id, conversation_id, downloadable): each file with its post; deleted files and posts are not downloaded."""
    p = posts.select(F.col("id").alias("post_id"), "conversation_id", F.col("delete_at").alias("post_deleted"))
    return files.join(p, "post_id").select(F.col("id").alias("file_id"), "post_id", "conversation_id", ((F.col("delete_at") == 0) & (F.col("post_deleted") == 0)).alias("downloadable"))


def restrict(configured: DataFrame, indexed: DataFrame, aliases: DataFrame) -> DataFrame:
    """(alias, id, status): requested aliases as ok, unindexed or unknown."""
    known = configured.select("alias", "id").join(indexed.select("id").distinct().withColumn("held", F.lit(True)), "id", "left")
    status = F.when(F.col("id").isNull(), "unknown").when(F.col("held"), "ok").otherwise("unindexed")
    return aliases.select("alias").distinct().join(F.broadcast(known), "alias", "left").select("alias", "id", status.alias("status"))


def narrow_by_ticket(routed: DataFrame, ticket_conversations: DataFrame) -> DataFrame:
    """Routed conversations that a ticket stands in; all of them if it stands in none."""
    hit = routed.join(ticket_conversations.select(F.col("conversation_id").alias("id")).distinct().withColumn("hit", F.lit(True)), "id", "left")
    some = F.coalesce(F.max("hit").over(Window.partitionBy(F.lit(1))), F.lit(False))  # the configuration is a small table
    return hit.withColumn("some", some).where(~F.col("some") | F.coalesce("hit", F.lit(False))).select(*routed.columns)


def last_write_wins(rows: DataFrame, key: list[str], arrival: str) -> DataFrame:
    """The row of each key that came last."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(arrival)).alias("r")).select(*key, "r.*")


def first_write_wins(rows: DataFrame, key: list[str], arrival: str) -> DataFrame:
    """The row of each key that came first: later inserts are ignored."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(arrival)).alias("r")).select(*key, "r.*")


def with_flags(rows: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Boolean columns of a JSON column: true for true and "true"."""
    return rows.withColumns({n: F.coalesce(F.lower(F.get_json_object(column, f"$.{n}")) == "true", F.lit(False)) for n in names})


def by_automation(posts: DataFrame, users: DataFrame, suppressed: list[str] = (), props: str = "props") -> DataFrame:
    """(thread_id): threads that nobody answered, whose root comes from a bot, a suppressed author, or a hook."""
    roots = with_flags(posts.where("id = thread_id"), props, ["from_bot", "from_webhook"])
    rows = roots.join(users.select(F.col("id").alias("user_id"), "is_bot", "username"), "user_id", "left")
    made = F.coalesce("is_bot", F.lit(False)) | F.col("username").isin(list(suppressed)) | F.col("from_bot") | F.col("from_webhook")
    answered = posts.where(LIVE).where("id <> thread_id").select("thread_id").distinct()
    return rows.where(F.coalesce(made, F.lit(False))).join(answered, "thread_id", "left_anti").select("thread_id")


def permalink(host: str, post_id: Column) -> Column:
    return F.concat(F.lit(f"{host.rstrip('/')}/_redirect/pl/"), F.url_encode(post_id))


def display_name(first: Column, last: Column, nickname: Column) -> Column:
    """First and last name, else the nickname, null if all are blank."""
    full = F.trim(F.concat_ws(" ", F.nullif(F.trim(first), F.lit("")), F.nullif(F.trim(last), F.lit(""))))
    return F.coalesce(F.nullif(full, F.lit("")), F.nullif(F.trim(nickname), F.lit("")))


def roster(posts: DataFrame, users: DataFrame, roles: dict[str, str]) -> DataFrame:
    """(user_id, username, display_name, role, role_source, is_bot): known authors; a profile's position goes before the configured role."""
    own = F.nullif(F.trim("position"), F.lit(""))
    table = F.create_map(*[F.lit(x) for kv in roles.items() for x in kv]) if roles else F.create_map().cast("map<string,string>")
    configured = F.nullif(F.trim(F.element_at(table, F.col("username"))), F.lit(""))
    source = F.when(own.isNotNull(), "profile").when(configured.isNotNull(), "config")
    people = users.join(posts.select(F.col("user_id").alias("id")).distinct(), "id", "left_semi")
    return people.select(F.col("id").alias("user_id"), "username", display_name(F.col("first_name"), F.col("last_name"), F.lit("")).alias("display_name"), F.coalesce(own, configured).alias("role"), source.alias("role_source"), "is_bot")


def boundary(posts: DataFrame) -> DataFrame:
    """(thread_id, root_present, one_conversation, one_root, ok): whether a thread's posts form one thread."""
    by = posts.groupBy("thread_id").agg(
        F.bool_or(F.col("id") == F.col("thread_id")).alias("root_present"), (F.count_distinct("conversation_id") == 1).alias("one_conversation"),
        F.bool_and((F.col("id") == F.col("thread_id")) | (F.col("root_id") == F.col("thread_id"))).alias("one_root"),
    )
    return by.withColumn("ok", F.col("root_present") & F.col("one_conversation") & F.col("one_root"))


def post_shapes(posts: DataFrame, files: DataFrame, long: int = 400) -> DataFrame:
    """(id, media_only, fenced, structural, file_or_fence, structural_short): what kind of post each is, by text and live files."""
    held = files.where(LIVE).select(F.col("post_id").alias("id")).distinct().withColumn("file", F.lit(True))
    p = posts.join(held, "id", "left").withColumn("file", F.coalesce("file", F.lit(False)))
    fence, keys = F.col("message").contains("```"), F.size(T.ticket_keys(F.col("message"))) >= 2
    return p.select(
        "id", ((F.col("delete_at") == 0) & ~F.col("message").rlike(r"\S") & F.col("file")).alias("media_only"), fence.alias("fenced"), (F.col("file") | fence | keys | (F.length("message") >= long)).alias("structural"),
        (F.col("file") | fence).alias("file_or_fence"), (F.col("file") | fence | keys).alias("structural_short"),
    )


def tails(posts: DataFrame) -> DataFrame:
    """(thread_id, id, kind): threads whose last post asks a question or reports an error."""
    last = posts.groupBy("thread_id").agg(F.max_by(F.struct("id", "message", "delete_at"), F.struct("create_at", "id")).alias("l")).select("thread_id", "l.*")
    said = F.regexp_replace("message", r"\s+$", "")
    low = F.translate(F.lower(said), "ё", "е")
    failed = F.lit(False)
    for cue in ERROR_CUES:
        failed = failed | low.contains(cue)
    kind = F.when(said.endswith("?"), "question").when(failed, "error")
    return last.where(LIVE).select("thread_id", "id", kind.alias("kind")).where("kind IS NOT NULL")


def current_matches(posts: DataFrame, probes: list[tuple[str, list[str]]]) -> DataFrame:
    """(thread_id, id): live posts that hold a term of a probe all of whose terms the thread holds; of a probe without terms, its value."""
    p = posts.where(LIVE).withColumn("low", F.translate(F.lower("message"), "ё", "е"))
    w, hit = Window.partitionBy("thread_id"), F.lit(False)
    for value, terms in probes:
        if not terms:
            hit = hit | T.contains_exact(F.col("low"), value.lower())
            continue
        held = [T.contains_exact(F.col("low"), t.lower()) for t in terms]
        every, some = F.lit(True), F.lit(False)
        for h in held:
            every, some = every & (F.max(h.cast("int")).over(w) == 1), some | h
        hit = hit | (every & some)
    return p.withColumn("hit", hit).where("hit").select("thread_id", "id")


def uncovered_terms(posts: DataFrame, terms: list[str]) -> DataFrame:
    """(thread_id, covered, missing): which terms a thread's live posts hold."""
    low = F.translate(F.lower("message"), "ё", "е")
    held = F.array_compact(F.array(*[F.when(T.contains_exact(low, t.lower()), t) for t in terms]))
    by = posts.where(LIVE).groupBy("thread_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(held)))).alias("covered"))
    return by.withColumn("missing", F.array_sort(F.array_except(F.array(*[F.lit(t) for t in terms]), "covered")))


def ranked_ticket_keys(mentions: DataFrame, hops: int = 3) -> DataFrame:
    """(request, key, mentions, in_window, bulletin_only, best_rank, latest_at, first_id, place, hop): each request's related keys, focused ones first.

    mentions: (request, key, id, thread_rank, in_window, bulletin, create_at). Keys that only bulletins name are hops only if fewer than two others are there.
    """
    first = F.struct(F.col("bulletin").cast("int"), "thread_rank", (~F.col("in_window")).cast("int"), "create_at", "id")
    by = mentions.groupBy("request", "key").agg(
        F.count(F.lit(1)).alias("mentions"), F.count_if("in_window").alias("in_window"), F.bool_and("bulletin").alias("bulletin_only"), F.min("thread_rank").alias("best_rank"), F.max("create_at").alias("latest_at"), F.min_by("id", first).alias("first_id"),
    )
    w = Window.partitionBy("request")
    order = w.orderBy(F.col("bulletin_only").cast("int"), (F.col("best_rank") != 0).cast("int"), "best_rank", F.desc("in_window"), F.desc("mentions"), F.desc("latest_at"), "key")
    ranked = by.withColumns({"place": F.row_number().over(order), "focused": F.sum((~F.col("bulletin_only")).cast("int")).over(w)})
    hop = F.when(F.col("focused") >= 2, ~F.col("bulletin_only")).otherwise(F.lit(True)) & (F.col("place") <= hops)
    return ranked.withColumn("hop", hop).drop("focused")


def tracker_url(text: Column, key: Column) -> Column:
    """The first tracker address that names a key."""
    urls = F.transform(F.regexp_extract_all(text, F.lit(T.URL), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:!?\])}]+$", ""))
    tracker = r"(?i)^https?://(tracker\.|jira\.|[^/\s]*\.(tracker|jira)\.|[^/\s]*youtrack|([^/\s]*\.)?atlassian\.net)"
    return F.get(F.filter(urls, lambda u: F.upper(u).contains(key) & u.rlike(tracker)), F.lit(0))


def around_sides(requested: Column, budget: Column, average: Column, most: int = 50) -> Column:
    """Posts of a window's side that fit a budget beside the anchor."""
    fits = F.greatest(F.lit(1), F.floor(F.greatest(F.lit(0), budget) / F.greatest(F.lit(1), average))) - 1
    return F.least(F.greatest(F.lit(0), F.floor(requested)), fits, F.lit(most)).cast("long")


def surround(posts: DataFrame, roots: DataFrame, subject: str, most_replies: int = 3) -> DataFrame:
    """(thread_id, prior_id, relevance): the roots before each short thread, and whether any of them may bear on it.

    roots: (id, prior_id) of threads.preceding_roots(). possible: one names the subject or shares a word over two letters with the root, or the root has under two such words.
    """
    key = subject.upper()
    said = T.tokens(F.regexp_replace(F.regexp_replace("message", T.URL, " "), rf"(?i)\Q{key}\E", " "))
    words = F.array_distinct(F.filter(said, lambda t: (F.length(t) > 2) & ~t.isin(T.STOP_WORDS)))
    p = posts.withColumns({"words": words, "names": F.array_contains(T.ticket_keys(F.col("message")), key)}).select("id", "thread_id", "words", "names")
    short = posts.where(LIVE).groupBy("thread_id").agg((F.count(F.lit(1)) - 1).alias("replies")).where(F.col("replies") <= most_replies).select(F.col("thread_id").alias("id"))
    pairs = roots.join(short, "id", "left_semi").join(p.select("id", F.col("words").alias("own")), "id").join(p.select(F.col("id").alias("prior_id"), "words", "names"), "prior_id")
    related = F.max((F.col("names") | F.arrays_overlap("own", "words")).cast("int")).over(Window.partitionBy("id")) == 1
    return pairs.select(F.col("id").alias("thread_id"), "prior_id", F.when(related | (F.size("own") < 2), "possible").otherwise("low").alias("relevance"))
