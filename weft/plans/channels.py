"""The retrieval driver: requests of probes, a strong pass, and a weak pass for what the strong one left uncovered.

Requests and their coverage are small and planned on the driver; those of any number of
subjects are one table, which one plan joins with the stored index and cuts to the best of each request.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import stems, subjects
from weft.functions import text as T
from weft.operators import retrieval
from weft.operators.index import START, STEM, PostIndex, common

MOST_HITS, MOST_FUZZY, MOST_MORPH = 100, 8, 8
HITS = "request int, probe int, source string, query string, id string, thread_id string, score double, rank int, subject int"


@dataclass(frozen=True)
class Request:
    """channel is how posts are matched; source is what fusion counts it as."""

    number: int
    probe: int
    channel: str
    source: str
    value: str
    subject: int = 0


def words_of(value: str) -> list[str]:
    return re.findall(r"[^\W_]+", subjects.normalize(value))


def strong_requests(probes: list[subjects.Probe], first: int = 0, subject: int = 0) -> list[Request]:
    flat = [(i, channel, value) for i, p in enumerate(probes) for channel, value in subjects.requests(p)]
    return [Request(first + n, i, channel, channel, value, subject) for n, (i, channel, value) in enumerate(flat)]


def weak_requests(probes: list[subjects.Probe], covered: dict[int, set[str]], concepts: dict[str, list[str]] | None = None, first: int = 0, subject: int = 0) -> list[Request]:
    """Stems together and each, concepts, expansions, and typo channels of terms that nothing has covered yet."""
    flat: list[tuple[int, str, str, str]] = []
    for i, p in enumerate(probes):
        morph = [(t, stems.token_stem(t)) for t in p.terms if re.fullmatch("[а-яё]+", t)][:MOST_MORPH]
        if len(morph) > 1:
            flat.append((i, "morph_fts", "morph_fts", " ".join(m for _, m in morph)))
        flat += [(i, "morph_fts", "morph_fts", m) for m in dict.fromkeys(m for _, m in morph)]
        low = subjects.normalize(p.value)
        flat += [(i, "concept_fts", "concept_fts", c) for c, aliases in sorted((concepts or {}).items()) if any(subjects.normalize(a) in low for a in aliases)]
        flat += [(i, "exact_phrase" if " " in value else "term_fts", kind, value) for _, value, kind in p.expansions]
        left = [t for t in p.terms if t not in covered.get(i, set())][:MOST_FUZZY]
        flat += [(i, channel, channel, t) for t in left for channel in subjects.typo_channels(t)[:1]]
    return [Request(first + n, *r, subject) for n, r in enumerate(dict.fromkeys(flat))]


KINDS = {"exact_phrase": "phrase", "prefix_fts": "count", "trigram": "likeness"}
_EXPANDED = "request int, kind string, need int, place int, token string, likeness double"


def expanded(index: PostIndex, requests: list[Request]) -> DataFrame:
    """(request, kind, need, place, token, likeness): the index tokens that each request asks for.

    Words, stems and concepts are known here; words that begin like one, or are like one, come
    from the trigrams of the index: those that share enough of them are compared by edit distance.
    """
    spark, exact, starts, likes = index.spark, [], [], []
    for r in requests:
        words = words_of(r.value)
        kind = KINDS.get(r.channel, "bm25")
        if r.channel == "prefix_fts":
            starts += [(r.number, words[0])] if words and len(words[0]) >= 4 else []
        elif r.channel == "trigram":
            policy = subjects.trigram_policy(words[0]) if len(words) == 1 else None
            likes += [(r.number, words[0], *policy)] if policy else []
        elif r.channel == "concept_fts":
            exact.append((r.number, kind, 1, 0, f"zzconcept{r.value.encode().hex()}", 0.0))
        else:
            phrase = kind == "phrase" or (r.channel == "term_fts" and len(words) > 1)  # a term with a hyphen is a phrase to the index
            kind = "phrase" if phrase and len(words) > 1 else "bm25"
            tokens = words if kind == "phrase" else list(dict.fromkeys(STEM + w if r.channel == "morph_fts" else w for w in words))
            need = 1 if r.channel == "broad_fts" else len(tokens)
            exact += [(r.number, kind, need, i, t, 0.0) for i, t in enumerate(tokens)]
    out = spark.createDataFrame(exact, _EXPANDED)
    if starts:
        asked = spark.createDataFrame([(n, START + w[:4], w) for n, w in starts], "request int, gram string, word string")
        near = index.grams(sorted({START + w[:4] for _, w in starts})).join(asked, "gram").where(F.col("token").startswith(F.col("word")))
        out = out.unionByName(near.selectExpr("request", "'count' AS kind", "1 AS need", "0 AS place", "token", "0D AS likeness"))
    if likes:
        of = {w: sorted({w[i : i + 3] for i in range(len(w) - 2)}) for _, w, _, _ in likes}
        asked = spark.createDataFrame([(n, g, w, len(of[w]), least, edits) for n, w, least, edits in likes for g in of[w]], "request int, gram string, word string, own int, least double, edits int")
        shared = index.grams(sorted({g for x in of.values() for g in x})).join(asked, "gram").groupBy("request", "token", "word", "own", "least", "edits").agg(F.count(F.lit(1)).alias("shared"))
        dice = shared.withColumn("likeness", 2 * F.col("shared") / (F.size(T.trigrams(F.col("token"))) + F.col("own")))
        near = dice.where((F.col("likeness") >= F.col("least")) & (F.levenshtein("token", "word") <= F.col("edits")))
        out = out.unionByName(near.selectExpr("request", "'likeness' AS kind", "1 AS need", "0 AS place", "token", "likeness"))
    return out


def run(index: PostIndex, requests: list[Request], scope: DataFrame | None = None) -> DataFrame:
    """The best hits of each request with their rank: by score, then newest, then id. scope: (id) of conversations.

    All requests are one table, joined once with the postings of their tokens. Each keeps its MOST_HITS
    best: tasks cut to that many before anything is shuffled by request.
    """
    spark = index.spark
    if not requests:
        return spark.createDataFrame([], HITS)
    asked = expanded(index, requests)
    postings = index.postings_of(asked)
    df = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    met = postings.join(asked.join(df, "token"), "token")
    shifted = F.when(F.col("kind") == "phrase", F.transform("positions", lambda p: p - F.col("place")))
    post = ["id", "thread_id", "conversation_id", "create_at", "doc_len"]
    by = met.groupBy("request", "kind", "need", *post).agg(F.count(F.lit(1)).alias("n"), F.sum(index.bm25("df", "tf", "doc_len")).alias("bm25"), F.max("likeness").alias("likeness"), F.collect_list(shifted).alias("starts"))
    by = by.where(F.col("n") >= F.col("need"))
    score = F.when(F.col("kind") == "count", F.col("n").cast("double")).when(F.col("kind") == "likeness", F.col("likeness")).otherwise(F.col("bm25"))
    single = by.where("kind <> 'phrase'").select("request", *post, score.alias("score"))
    if any(len(words_of(r.value)) > 1 and r.channel in ("exact_phrase", "term_fts") for r in requests):
        phrases = by.where("kind = 'phrase'").select("request", *post, F.size(common("starts")).alias("tf")).where("tf > 0")
        counts = phrases.groupBy("request").agg(F.count(F.lit(1)).alias("df"))
        single = single.unionByName(phrases.join(counts, "request").select("request", *post, index.bm25("df", "tf", "doc_len").alias("score")))
    scored = single if scope is None else single.join(scope.select(F.col("id").alias("conversation_id")), "conversation_id", "left_semi")
    rank = F.row_number().over(Window.partitionBy("request").orderBy(F.desc(F.round("score", 12)), F.desc("create_at"), "id"))
    best = scored.withColumn("rank", rank).where(F.col("rank") <= MOST_HITS)
    named = spark.createDataFrame([(r.number, r.probe, r.source, r.value, r.subject) for r in requests], "request int, probe int, source string, query string, subject int")
    return best.join(named, "request").withColumn("score", -F.col("score")).select(*(c.split()[0] for c in HITS.split(", ")))


def coverage(requests: list[Request], found: set[int], probes: list[subjects.Probe]) -> dict[int, set[str]]:
    """Terms of each probe that a strong request found; found: the numbers of requests with a hit."""
    out: dict[int, set[str]] = {}
    for r in requests:
        if r.number in found:
            own = out.setdefault(r.probe, set())
            if r.channel == "term_fts":
                own.add(subjects.normalize(r.value))
            elif r.channel in ("exact_phrase", "strict_fts"):
                own.update(probes[r.probe].terms)
    return out


@dataclass(frozen=True)
class Subject:
    """What one searcher asks for; strong_ticket: a ticket whose edges were found, which needs no weak pass."""

    probes: list[subjects.Probe]
    strong_ticket: bool = False


def retrieve_batch(index: PostIndex, batch: list[Subject], scope: DataFrame | None = None) -> DataFrame:
    """Hits of all subjects, numbered by their place in the batch: a strong pass over all, and a weak one over those that need it.

    Two plans serve a batch of any size. Of the strong pass only the numbers of requests with a hit reach the driver.
    """
    strong: list[Request] = []
    for k, s in enumerate(batch):
        strong += strong_requests(s.probes, len(strong), k)
    hits = run(index, strong, scope)
    open_ = [k for k, s in enumerate(batch) if not s.strong_ticket]
    if not open_:
        return hits
    found = {r["request"] for r in hits.select("request").distinct().collect()}
    weak: list[Request] = []
    for k in open_:
        own = [r for r in strong if r.subject == k]
        weak += weak_requests(batch[k].probes, coverage(own, found, batch[k].probes), index.concepts, len(strong) + len(weak), k)
    return hits.unionByName(run(index, weak, scope))


def retrieve(index: PostIndex, probes: list[subjects.Probe], strong_ticket: bool = False, scope: DataFrame | None = None) -> DataFrame:
    """Hits of one subject."""
    return retrieve_batch(index, [Subject(probes, strong_ticket)], scope)


def contributions(hits: DataFrame) -> DataFrame:
    """(subject, thread_id, probe, source, query, rank, score): of each thread, probe and source the best request, by the thread's place among its hits."""
    first = hits.groupBy("request", "subject", "probe", "source", "query", "thread_id").agg(F.min("rank").alias("first"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("request").orderBy("first")))  # at most MOST_HITS rows a request
    weight = F.create_map(*[F.lit(x) for kv in retrieval.WEIGHTS.items() for x in kv])
    score = weight[F.col("source")] / (retrieval.RRF + F.col("rank"))
    best = ranked.withColumn("score", score).groupBy("subject", "thread_id", "probe", "source").agg(F.min_by(F.struct("query", "rank", "score"), F.struct(-F.col("score"), F.col("rank"), F.col("query"))).alias("b"))
    return best.select("subject", "thread_id", "probe", "source", "b.query", "b.rank", "b.score")


def fusion(parts: DataFrame) -> DataFrame:
    """(subject, thread_id, fusion, sources): the sum of a thread's contributions and where they come from, in order."""
    ordered = F.array_sort(F.collect_list(F.struct("probe", "source", "query", "rank", "score")))
    by = parts.groupBy("subject", "thread_id").agg(ordered.alias("c"))
    return by.select("subject", "thread_id", F.aggregate("c", F.lit(0.0), lambda s, x: s + x["score"]).alias("fusion"), F.transform("c", lambda x: x["source"]).alias("sources"))


def remote(parts: DataFrame, most_posts: int = 20, most_threads: int = 12) -> DataFrame:
    """(thread_id, fusion): candidates of a second source of posts (probe, rank, thread_id), by reciprocal rank, each thread once a probe."""
    best = parts.where(F.col("rank") <= most_posts).groupBy("probe", "thread_id").agg(F.min("rank").alias("rank"))
    by = best.groupBy("thread_id").agg(F.sum(1 / (retrieval.RRF + F.col("rank"))).alias("fusion"))
    return by.orderBy(F.desc("fusion"), "thread_id").limit(most_threads)
