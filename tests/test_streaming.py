from pyspark.sql import functions as F

import pytest

from weft.operators.index import TABLES, PostIndex
from weft.operators.writes import versioned_upsert
from weft.sources.bucketed import VersionConflict
from weft.streaming import sync

SCHEMA = "id string, arrival long, update_at long, delete_at long, message string"


def test_micro_batches_equal_one_upsert_and_replay_is_idempotent(spark, tmp_path):
    rows = [(f"p{i % 7}", i, (i * 37) % 50, 0 if i % 5 else 60, f"m{i}") for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    for part in range(4):
        df.where(F.col("arrival") % 4 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table = sync.UpsertTable(spark, str(tmp_path / "table"), df.schema)
    sync.replay(spark, str(tmp_path / "in"), df.schema, lambda s: s, table, str(tmp_path / "check"))
    want = sorted(tuple(r) for r in versioned_upsert(df).select(*df.columns).collect())
    assert sorted(tuple(r) for r in table.read().collect()) == want
    table.upsert(df.where("arrival > 30"))
    assert sorted(tuple(r) for r in table.read().collect()) == want


def test_a_restart_goes_on_from_what_is_stored(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 1, 0, "x"), ("b", 2, 1, 0, "y")], SCHEMA)
    sync.UpsertTable(spark, str(tmp_path), df.schema).upsert(df.where("id = 'a'"))
    again = sync.UpsertTable(spark, str(tmp_path), df.schema)
    again.upsert(df.where("id = 'b'"))
    assert sorted(r["id"] for r in again.read().collect()) == ["a", "b"]
    for i in range(4):
        again.upsert(df.where("id = 'b'").withColumn("message", F.lit(f"y{i}")))
    assert sorted((r["id"], r["message"]) for r in sync.UpsertTable(spark, str(tmp_path), df.schema).read().collect()) == [("a", "x"), ("b", "y3")]
    assert len(again.table._versions()) == 2


def test_a_second_writer_of_one_version_is_refused(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("a", 1, 1, 0, "x")], SCHEMA)
    table = sync.UpsertTable(spark, str(tmp_path), df.schema)
    table.upsert(df)
    old = table.table.manifest()
    table.upsert(df)
    real = table.table.manifest
    monkeypatch.setattr(table.table, "manifest", lambda version=None: old if version is None else real(version))
    with pytest.raises(VersionConflict):
        table.upsert(df)


def test_windows_and_limits():
    assert sync.initial_window(None, None, 10) == 0
    assert sync.initial_window(5, 100_000, 200_000) == 70_000
    assert sync.too_many(1000) and not sync.too_many(999)


def test_one_failure_does_not_stop_the_others():
    done = []

    def one(c):
        if c == "b":
            raise ValueError("no")
        done.append(c)

    with pytest.raises(ValueError):
        sync.sync_all(["a", "b", "c"], one)
    assert done == ["a", "c"]


def test_deltas_by_checkpoint_and_their_limit(spark):
    posts = spark.createDataFrame([(f"p{i}", "c1" if i < 3 else "c2", i * 1000, i * 1000, 0) for i in range(6)], "id string, conversation_id string, create_at long, update_at long, delete_at long")
    state = spark.createDataFrame([("c1", 31_500)], "conversation_id string, last_success_at long")
    got = sync.delta(posts, state, 4_000, history_ms=500)
    assert sorted(r["id"] for r in got.collect()) == ["p2", "p4", "p5"]
    assert [r["conversation_id"] for r in sync.refused(got, 2).collect()] == ["c2"]


def test_index_update_equals_a_fresh_build(spark, tmp_path):
    ddl = "id string, root_id string, thread_id string, conversation_id string, user_id string, create_at bigint, update_at bigint, delete_at bigint, message string"
    rows = [(f"p{i}", "", f"p{i}", "c", "u", i, i, 0, f"word{i % 3} common text {i}") for i in range(12)]
    index = PostIndex(spark, str(tmp_path / "a"), 4).build(spark.createDataFrame(rows, ddl))
    changed = [("p1", "", "p1", "c", "u", 1, 50, 0, "quite new words"), ("p2", "", "p2", "c", "u", 2, 2, 60, "gone"), ("p3", "", "p3", "c", "u", 3, 1, 0, "stale edit"), ("q", "", "q", "c", "u", 9, 9, 0, "common newcomer")]
    index.update(spark.createDataFrame(changed, ddl))
    final = {r[0]: r for r in rows} | {r[0]: r for r in changed if r[0] != "p3"}
    fresh = PostIndex(spark, str(tmp_path / "b"), 4).build(spark.createDataFrame(list(final.values()), ddl))
    read = lambda x, name: sorted(tuple(map(str, r)) for r in x.table(name).collect())
    assert all(read(index, name) == read(fresh, name) for name in TABLES) and index.meta() == fresh.meta()
    assert sorted(r["id"] for r in index.phrase(["common", "newcomer"]).collect()) == ["q"]
    again = PostIndex(spark, str(tmp_path / "a"), 4)
    assert again.built and again.postings(["Words"]).count() == 1 and again.prefix("newc").count() == 1
