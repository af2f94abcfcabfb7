"""Incremental ingest: micro-batches are upserted by version, so re-reading an overlap changes nothing.

No watermark drops late rows: an edit or a deletion may come at any time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weft.operators.writes import versioned_upsert
from weft.sources.bucketed import BucketedTable

MOST_DELTA = 1000


class UpsertTable:
    """A table of one row a key, kept in buckets under a path; it outlives the process that writes it."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str = "id", buckets: int = 16):
        self.key, self.schema = key, schema
        self.table = BucketedTable(spark, path, schema, key, buckets)

    def read(self) -> DataFrame:
        return self.table.read()

    def upsert(self, batch: DataFrame, _epoch: int = 0) -> None:
        """For foreachBatch: only buckets with a row of the batch are written anew. Repeating a batch changes nothing."""
        rows = batch.select(*self.schema.names)
        touched = self.table.touched(rows)
        if touched:
            self.table.commit(versioned_upsert(self.table.read(touched).unionByName(rows), self.key), touched)


def replay(spark: SparkSession, source: str, schema: StructType, project, table: UpsertTable, checkpoint: str, files_a_batch: int = 1) -> None:
    """Reads all files that are there, in micro-batches, and stops."""
    stream = project(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source))
    query = stream.writeStream.foreachBatch(table.upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def initial_window(newest_ms: int | None, last_success_ms: int | None, now_ms: int, overlap_ms: int = 30_000, history_ms: int = 365 * 86_400_000) -> int:
    """From when to read: the last success less an overlap, or the bounded history."""
    if newest_ms is None or last_success_ms is None:
        return max(0, now_ms - history_ms)
    return max(0, last_success_ms - overlap_ms)


def too_many(n_rows: int, most: int = MOST_DELTA) -> bool:
    """Whether a delta is refused, so that the checkpoint stays and a full sync follows."""
    return n_rows >= most


def delta(posts: DataFrame, state: DataFrame, now_ms: int, overlap_ms: int = 30_000, history_ms: int = 365 * 86_400_000) -> DataFrame:
    """(posts columns): what each conversation reads anew by its checkpoint; state: (conversation_id, last_success_at). Unknown conversations read the bounded history."""
    since = F.greatest(F.lit(0), F.coalesce(F.col("last_success_at") - overlap_ms, F.lit(now_ms - history_ms)))
    return posts.join(state.select("conversation_id", "last_success_at"), "conversation_id", "left").where(F.greatest("create_at", "update_at", "delete_at") >= since).select(*posts.columns)


def refused(changes: DataFrame, most: int = MOST_DELTA) -> DataFrame:
    """(conversation_id, n): conversations whose delta is too large, whose checkpoint stays."""
    return changes.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= most)


def sync_all(conversations: list[str], one: Callable[[str], None]) -> list[str]:
    """Syncs each conversation; all are tried, the first failure is raised when all are done. Gives those that succeeded."""
    done, first = [], None
    for c in conversations:
        try:
            one(c)
            done.append(c)
        except Exception as e:  # noqa: BLE001 - whatever failed, the others go on
            first = first or e
    if first is not None:
        first.add_note(f"done before: {', '.join(done) or 'none'}")
        raise first
    return done
