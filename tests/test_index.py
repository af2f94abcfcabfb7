"""The index as one unit: what a lost writer leaves, posts that move, what follows from files and users, and what a search reads."""

import pytest

from weft.operators.index import TABLES, PostIndex
from weft.plans import channels
from weft.sources.bucketed import TableSet, bucket_number, buckets_for

POSTS = "id string, root_id string, thread_id string, conversation_id string, user_id string, create_at bigint, update_at bigint, delete_at bigint, message string"
FILES = "id string, post_id string, name string, size bigint, delete_at bigint"
USERS = "id string, username string"
ROWS = [(f"p{i}", "", f"t{i // 3}", "c", f"u{i % 2}", i, i, 0, f"word{i % 4} common text {i} PROJ-{i % 3}") for i in range(12)]


def frame(spark, rows, ddl=POSTS):
    return spark.createDataFrame(rows, ddl)


def content(index):
    return {name: sorted(tuple(map(str, r)) for r in index.table(name).collect()) for name in TABLES} | {"meta": index.meta()}


@pytest.fixture
def index(spark, tmp_path):
    files, users = frame(spark, [("f1", "p1", "plan.csv", 5, 0), ("f2", "p4", "old.png", 5, 0)], FILES), frame(spark, [("u0", "ann"), ("u1", "bob")], USERS)
    return PostIndex(spark, str(tmp_path / "index"), 3).build(frame(spark, ROWS), files, users)


CHANGED = [("p1", "", "t9", "c", "u0", 1, 50, 0, "moved gamma"), ("p2", "", "t0", "c", "u1", 2, 2, 60, "gone"), ("p3", "", "t1", "c", "u1", 3, 1, 0, "stale edit"), ("q", "", "t1", "c", "u0", 9, 9, 0, "newcomer OPS-5")]


def test_a_lost_writer_leaves_the_version_before(spark, index, monkeypatch):
    before = content(index)
    real, writes = TableSet.stage, []
    monkeypatch.setattr(TableSet, "stage", lambda self, name, rows, n: writes.append(name) or real(self, name, rows, n))
    once = PostIndex(spark, index.set.path)
    monkeypatch.setattr(TableSet, "publish", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        once.update(frame(spark, CHANGED))
    n = len(writes)
    assert n > 8 and content(PostIndex(spark, index.set.path)) == before
    for k in (1, 3, n - 1):  # lost before the k-th write
        writes.clear()
        monkeypatch.setattr(TableSet, "stage", lambda self, name, rows, b, k=k: (writes.append(name), real(self, name, rows, b))[1] if len(writes) < k else (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            once.update(frame(spark, CHANGED))
        assert content(PostIndex(spark, index.set.path)) == before
    monkeypatch.undo()
    after = content(PostIndex(spark, index.set.path).update(frame(spark, CHANGED)))
    assert after != before and after == content(PostIndex(spark, index.set.path))
    named = {f.split("/")[0] for v in index.set._versions() for t in index.set.manifest(v)["tables"].values() for f in t["folders"].values()}
    assert {f for f in index.set._names("") if f.startswith("data-")} == named  # what lost writers left is gone


def test_updates_equal_a_fresh_build(spark, index, tmp_path):
    files, users = frame(spark, [("f2", "p5", "new.pdf", 7, 0), ("f3", "q", "q.log", 7, 0)], FILES), frame(spark, [("u1", "rob")], USERS)
    index.update(frame(spark, CHANGED))
    index.update(files=files, users=users)
    index.update(frame(spark, [("p4", "", "t1", "c", "u1", 4, 70, 0, "later words")]))
    index.update()
    final = {r[0]: r for r in ROWS} | {r[0]: r for r in CHANGED if r[0] != "p3"} | {"p4": ("p4", "", "t1", "c", "u1", 4, 70, 0, "later words")}
    fresh = PostIndex(spark, str(tmp_path / "fresh"), 3)
    fresh.build(frame(spark, list(final.values())), frame(spark, [("f1", "p1", "plan.csv", 5, 0), ("f2", "p5", "new.pdf", 7, 0), ("f3", "q", "q.log", 7, 0)], FILES), frame(spark, [("u0", "ann"), ("u1", "rob")], USERS))
    assert content(index) == content(fresh)
    assert [r["thread_id"] for r in index.table("docs").where("id = 'p1'").collect()] == ["t9"]  # a moved post is stored once
    assert index.postings(["alpha"]).count() == 0 and index.postings(["gamma"]).count() == 1
    assert {r["post_id"] for r in index.entities("username", "Rob").collect()} == {"p3", "p4", "p5", "p7", "p9", "p11"}
    assert [r["id"] for r in index.edges("ops-5").collect()] == ["q"] and index.entities("attachment", "old.png").count() == 0


def test_checkpoints_are_replaced_by_conversation(spark, index):
    state = "conversation_id string, newest_post_id string, newest_post_at bigint, oldest_covered_at bigint, last_success_at bigint, error string"
    index.update(checkpoints=frame(spark, [("c", "p1", 1, 0, 5, None), ("d", "p2", 2, 0, 6, None)], state))
    index.update(frame(spark, CHANGED), checkpoints=frame(spark, [("c", "q", 9, 0, 10, None)], state))
    assert sorted(tuple(r) for r in index.table("checkpoints").collect()) == [("c", "q", 9, 0, 10, None), ("d", "p2", 2, 0, 6, None)]


def test_searches_read_their_buckets_alone(spark, tmp_path):
    rows = [(f"p{i}", "", f"t{i}", "c", "u", i, i, 0, f"token{i} gateway payment{i % 7}") for i in range(60)]
    index = PostIndex(spark, str(tmp_path), 40).build(frame(spark, rows))
    n = index.set.manifest()["tables"]["postings"]["n"]
    assert n == 40 and {f.split("/")[-2] for f in index.postings(["gateway"]).inputFiles()} == {f"__bucket={bucket_number('gateway', n)}"}
    asked = channels.expanded(index, [channels.Request(0, 0, "trigram", "trigram", "gatewey")])
    assert [(r["token"], r["kind"]) for r in asked.collect()] == [("gateway", "likeness")]
    grams = {bucket_number("gatewey"[i : i + 3], n) for i in range(5)}
    assert {int(f.split("__bucket=")[1].split("/")[0]) for f in asked.inputFiles()} <= grams
    assert channels.run(index, [channels.Request(0, 0, "trigram", "trigram", "gatewey")]).count() == 60


def test_bucket_numbers_are_those_of_spark(spark):
    values = ["", "a", "gateway", "платёж", "x" * 100, "PROJ-1", "1234567", "12345678", "123456789012"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").selectExpr("v", "CAST(pmod(xxhash64(v), 97) AS INT) AS b").collect()
    assert all(bucket_number(r["v"], 97) == r["b"] for r in rows)
    assert buckets_for(spark.createDataFrame([(1,)], "a int"), 5) == 5
