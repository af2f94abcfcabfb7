"""Lexical retrieval over postings: term, phrase, prefix and typo channels, BM25, rank fusion.

A batch of probes is answered in one pass: requests are a small table joined with the
postings on the term, and every channel is an aggregate over that join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions import text as T

K1, B, RRF = 1.2, 0.75, 60
# Weights of retrieval sources in fusion.
WEIGHTS = {
    "exact_phrase": 1.0, "strict_fts": 0.9, "term_fts": 0.75, "broad_fts": 0.55, "morph_fts": 0.45, "concept_fts": 0.35, "synonym": 0.35,
    "keyboard_layout": 0.25, "transliteration": 0.25, "mixed_script": 0.25, "prefix_fts": 0.2, "trigram": 0.15,
}


def token_rows(docs: DataFrame, key: str = "id", text: str = "message") -> DataFrame:
    """(id, pos, token)"""
    return docs.select(F.col(key).alias("id"), F.posexplode(T.tokens(F.col(text))).alias("pos", "token"))


def corpus_stats(docs: DataFrame, text: str = "message") -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size(T.tokens(F.col(text)))).alias("avg_len"))


def term_scores(docs: DataFrame, terms: list[str], key: str = "id", text: str = "message") -> DataFrame:
    """(id, token, score) of each document and query term it holds. Only postings of the query's terms are formed; statistics cover all documents."""
    wanted = [t.lower() for t in dict.fromkeys(terms)]
    toks = docs.select(F.col(key).alias("id"), T.tokens(F.col(text)).alias("toks"))
    rows = toks.select("id", F.size("toks").alias("doc_len"), F.explode(F.filter("toks", lambda t: t.isin(wanted))).alias("token"))
    hits = rows.groupBy("id", "doc_len", "token").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    df = hits.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    stats = corpus_stats(docs, text)
    raw = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # One row a query term: bounded by the query.
    idf = df.crossJoin(stats).select("token", "avg_len", F.when(raw <= 0, F.lit(1e-6)).otherwise(raw).alias("idf"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("avg_len")))
    return hits.join(F.broadcast(idf), "token").select("id", "token", (-part).alias("score"))


def bm25(docs: DataFrame, terms: list[str], key: str = "id", text: str = "message", mode: str = "any") -> DataFrame:
    """(id, bm25): negative is better. mode "any" takes documents with any term, "all" those with every term."""
    scored = term_scores(docs, terms, key, text).groupBy("id").agg(F.sum("score").alias("bm25"), F.count(F.lit(1)).alias("n"))
    return scored.where(F.col("n") == len({t.lower() for t in terms}) if mode == "all" else F.lit(True)).select("id", "bm25")


def phrase(docs: DataFrame, words: list[str], key: str = "id", text: str = "message") -> DataFrame:
    """(id, n): occurrences of a token sequence."""
    wanted = [w.lower() for w in words]
    toks = docs.select(F.col(key).alias("id"), T.tokens(F.col(text)).alias("toks"))
    toks = toks.where(F.size(F.array_intersect("toks", F.array(*[F.lit(w) for w in dict.fromkeys(wanted)]))) == len(set(wanted)))
    n = F.size(F.filter(F.sequence(F.lit(0), F.size("toks") - 1), _phrase_at(wanted)))
    return toks.select("id", n.cast("long").alias("n")).where("n > 0")


def _phrase_at(wanted: list[str]):
    def at(p):
        match = F.lit(True)
        for i, w in enumerate(wanted):
            match = match & F.coalesce(F.get("toks", p + i) == w, F.lit(False))
        return match

    return at


def prefix(docs: DataFrame, start: str, key: str = "id", text: str = "message") -> DataFrame:
    """(id, n): distinct tokens that begin with the prefix."""
    n = F.size(F.array_distinct(F.filter(T.tokens(F.col(text)), lambda t: t.startswith(start.lower()))))
    return docs.select(F.col(key).alias("id"), n.cast("long").alias("n")).where("n > 0")


def typo(docs: DataFrame, probe: str, key: str = "id", text: str = "message", least: float = 0.5, most_edits: int = 2, limit: int | None = None) -> DataFrame:
    """(id, similarity): the best token within the edit distance, by trigram likeness."""
    probe = probe.lower()
    scores = F.transform(F.array_distinct(T.tokens(F.col(text))), lambda t: T.trigram_similarity(t, probe, most_edits))
    found = docs.select(F.col(key).alias("id"), F.coalesce(F.array_max(scores), F.lit(0.0)).alias("similarity")).where(F.col("similarity") >= least)
    return found if limit is None else found.orderBy(F.desc("similarity"), "id").limit(limit)


def fuse(ranked: DataFrame) -> DataFrame:
    """(thread_id, fusion): of rows (thread_id, probe, source, rank) the best of each probe and source, weighted and summed."""
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    best = ranked.groupBy("thread_id", "probe", "source").agg(F.min("rank").alias("rank"))
    return best.groupBy("thread_id").agg(F.sum(weight[F.col("source")] / (RRF + F.col("rank"))).alias("fusion"))


def dedupe_matches(hits: DataFrame) -> DataFrame:
    """One hit for each post and probe: best source, then rank, then query."""
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    return hits.groupBy("id", "probe").agg(F.min_by(F.struct("source", "rank"), F.struct(-weight[F.col("source")], F.col("rank"), F.col("source"))).alias("b"), F.count(F.lit(1)).alias("evidence")).select("id", "probe", "b.source", "b.rank", "evidence")


def entity_search(entities: DataFrame, kind: str, value: str) -> DataFrame:
    return entities.where((F.col("kind") == kind) & (F.col("normalized_value") == value.lower())).select("post_id", "kind", "value")


def probes(spark: SparkSession, values: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "probe int, value string")
