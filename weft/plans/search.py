"""The search plan: probes to channels to fusion to threads ranked by their evidence, over the stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions import subjects
from weft.operators import evidence, ranking
from weft.operators.index import PostIndex
from weft.plans import channels

_open: dict[tuple[str, str, str], PostIndex] = {}


def state(spark: SparkSession, path: str) -> str:
    """What tells a changed file or folder from what it was: its files' names, sizes and times."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return " ".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in files))


def opened(spark: SparkSession, name: str, source: str, path: str, posts) -> PostIndex:
    """The index under a path, built from posts() if there is none; held by name for the session, as long as the source is what it was."""
    key = (spark.sparkContext.applicationId, name, state(spark, source))
    if key not in _open:
        index = PostIndex(spark, path)
        _open[key] = index if index.built else index.build(posts())
    return _open[key]


def subject_of(subject: str, queries: list[str] = ()) -> tuple[subjects.Subject, list[subjects.Probe]]:
    """What is searched for and its probes."""
    classified = subjects.classify(subject)
    return classified, subjects.resolve(classified, queries)


def fused_batch(index: PostIndex, batch: list[tuple[str, list[str]]], limit: int = 10) -> DataFrame:
    """(subject, thread_id, fusion, sources, place): the best threads by fusion of each subject (text, further queries), all in one plan."""
    fused = channels.fusion(channels.contributions(channels.retrieve_batch(index, [channels.Subject(subject_of(*x)[1]) for x in batch])))
    place = F.row_number().over(Window.partitionBy("subject").orderBy(F.desc(F.round("fusion", 9)), "thread_id"))
    return fused.withColumn("place", place).where(F.col("place") <= limit)


def candidates(index: PostIndex, subject: str, queries: list[str] = (), routed: DataFrame | None = None) -> DataFrame:
    """Rows of evidence.vectors() for the threads that retrieval finds for a subject.

    Hits are at most MOST_HITS a request, so their threads' ids reach the driver, and only the
    buckets of those threads are read. A ticket whose edges the index holds needs no weak pass.
    """
    what, probes = subject_of(subject, queries)
    ticket = what.value if what.kind == "ticket" else None
    edges = index.edges(ticket) if ticket else None
    hits = channels.retrieve_batch(index, [channels.Subject(probes, edges is not None and not edges.isEmpty())])
    rows = [(r["request"], r["probe"], r["source"], r["query"], r["id"], r["thread_id"], r["score"], r["rank"], r["subject"]) for r in hits.collect()]
    spark = index.spark
    hits = spark.createDataFrame(rows, channels.HITS)
    docs = index.threads(sorted({r[5] for r in rows}))
    shown = evidence.thread_evidence(docs, probes, ticket)
    metrics = structured = None
    if ticket:
        marked = docs.join(spark.createDataFrame(sorted({(r[4],) for r in rows}), "id string").withColumn("hit", F.lit(True)), "id", "left")
        metrics = evidence.ticket_metrics(evidence.coverage(marked, ticket, F.coalesce("hit", F.lit(False))), ticket)
        structured = edges.groupBy("thread_id").agg(F.count(F.lit(1)).alias("n"))
    everywhere = docs.select(F.col("conversation_id").alias("id")).distinct().withColumns({"weight": F.lit(1), "priority": F.lit(0)})
    fused = channels.fusion(channels.contributions(hits)).select("thread_id", F.round("fusion", 9).alias("fusion"))
    return evidence.vectors(shown, metrics, everywhere if routed is None else routed, fused, structured)


def search(index: PostIndex, subject: str, queries: list[str] = (), limit: int = 10, routed: DataFrame | None = None) -> DataFrame:
    """The best threads by the full score vector."""
    return ranking.order(candidates(index, subject, queries, routed), limit).select("thread_id", *ranking.FULL_VECTOR)
