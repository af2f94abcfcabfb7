"""The page stream: order, broken pages, isolation, replay and restart."""

import json

import pytest

from weft.operators.index import TABLES, PostIndex
from weft.sources.bucketed import TableSet
from weft.streaming import pages

POSTS = "id string, root_id string, thread_id string, conversation_id string, user_id string, create_at bigint, update_at bigint, delete_at bigint, message string"


def page(where, channel, n, posts, raw=None):
    folder = where / f"channel={channel}" / f"page={n}"
    folder.mkdir(parents=True)
    body = {"order": [p["id"] for p in posts] + ["ghost"], "posts": {p["id"]: {"channel_id": channel, "user_id": "u", **p} for p in posts}}
    (folder / "page.json").write_text(json.dumps(body) if raw is None else raw)


def post(i, at, text="text", **more):
    return {"id": i, "create_at": at, "update_at": at, "message": text, **more}


@pytest.fixture
def index(spark, tmp_path):
    return PostIndex(spark, str(tmp_path / "index"), 2).build(spark.createDataFrame([], POSTS))


def state(index):
    return {r["conversation_id"]: (r["newest_post_id"], r["newest_post_at"], r["oldest_covered_at"], r["last_success_at"], r["error"]) for r in index.table("checkpoints").collect()}


def ids(index):
    return sorted(r["id"] for r in index.table("docs").collect())


def test_one_channel_fails_and_the_others_go_on(spark, index, tmp_path):
    src, check = tmp_path / "in", str(tmp_path / "check")
    page(src, "a", 0, [post("a1", 10), post("a2", 20, root_id="a1")])
    page(src, "b", 0, [post("b1", 10)])
    page(src, "b", 1, [], "no json")
    page(src, "b", 2, [post("b2", 30)])
    page(src, "c", 0, [post("c1", 5, channel_id="other")])
    page(src, "d", 0, [post(f"d{i}", i) for i in range(6)])
    pages.sync(spark, str(src), index, check, 100, most=6)
    assert ids(index) == ["a1", "a2", "b1"] and index.threads(["a1"]).count() == 2
    assert state(index) == {"a": ("a2", 20, 10, 100, None), "b": ("b1", 10, 10, None, "no page"), "c": (None, None, None, None, "another channel"), "d": (None, None, None, None, "too many changes")}
    page(src, "b", 3, [post("b3", 40)])
    page(src, "a", 1, [post("a0", 2), post("a2", 20, "edited", update_at=50), post("a1", 10, delete_at=60)])
    pages.sync(spark, str(src), index, check, 200, most=6)
    assert state(index)["a"] == ("a2", 20, 2, 200, None) and state(index)["b"] == ("b3", 40, 10, 200, None) and state(index)["d"][4] == "too many changes"
    assert {r["id"]: r["message"] for r in index.table("docs").collect()} == {"a0": "text", "a1": "", "a2": "edited", "b1": "text", "b3": "text"}


def test_a_lost_batch_is_repeated_and_a_repeated_one_changes_nothing(spark, index, tmp_path, monkeypatch):
    src, check = tmp_path / "in", str(tmp_path / "check")
    for n in range(3):
        page(src, "a", n, [post(f"p{n}", n + 1)])
    real, calls = TableSet.publish, []

    def lost(self, *a, **k):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return real(self, *a, **k)

    monkeypatch.setattr(TableSet, "publish", lost)
    with pytest.raises(Exception, match="lost"):
        pages.sync(spark, str(src), index, check, 100, files_a_batch=1)
    assert len(ids(index)) == 1
    pages.sync(spark, str(src), PostIndex(spark, index.set.path), check, 100, files_a_batch=1)
    assert ids(index) == ["p0", "p1", "p2"] and index.meta() == {"n_docs": 3, "total_len": 3, "epoch": 2}
    whole = {name: sorted(map(str, index.table(name).collect())) for name in TABLES}
    again = pages.parsed(spark.read.schema(pages.FILES).option("wholetext", True).text(str(src)))
    version = index.set.manifest()["version"]
    pages.PageSync(index, 999)(again, 2)
    assert index.set.manifest()["version"] == version
    pages.PageSync(index, 100)(again, 3)  # an overlap, read anew
    assert {name: sorted(map(str, index.table(name).collect())) for name in TABLES} == whole


def test_what_is_to_be_fetched(spark, index, tmp_path):
    page(tmp_path / "in", "a", 0, [post("a1", 1, user_id="ann", file_ids=["f1", "f2"]), post("a2", 2, user_id="bob")])
    index.update(users=spark.createDataFrame([("bob", "bob")], "id string, username string"), files=spark.createDataFrame([("f2", "a1", "x", 1, 0)], "id string, post_id string, name string, size bigint, delete_at bigint"))
    rows = pages.parsed(spark.read.schema(pages.FILES).option("wholetext", True).text(str(tmp_path / "in")))
    assert sorted(tuple(r) for r in pages.to_enrich(rows, index).collect()) == [("file", "f1"), ("user", "ann")]
