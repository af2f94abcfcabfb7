import json

import pytest

from weft.plans import benchmark
from weft.operators.index import PostIndex
from weft.plans.search import search
from weft.sources import downloads, paged


def post(i, at=1, **more):
    return {"id": i, "channel_id": "c", "user_id": "u", "message": f"m {i}", "create_at": at, "update_at": at, "delete_at": 0, **more}


def write(folder, channel, pages):
    (folder / channel).mkdir(parents=True)
    for n, ids in enumerate(pages):
        (folder / channel / f"{n}.json").write_text(json.dumps({"order": ids, "posts": {i: post(i, int(i[1:])) for i in ids if i != "p99"}}))


def test_pages(spark, tmp_path):
    write(tmp_path, "a", [["p5", "p4"], ["p3", "p99"], ["p2"]])
    write(tmp_path, "b", [["p7"], ["p1"]])
    spark.dataSource.register(paged.PostPages)
    read = lambda **o: sorted(r["id"] for r in spark.read.format("post_pages").options(path=str(tmp_path), page_size=2, **o).load().collect())
    assert read() == ["p2", "p3", "p4", "p5", "p7"]
    assert read(since=4) == ["p4", "p5", "p7"]
    assert read(before="p4") == ["p2", "p3"]
    assert read(after="p3") == ["p4", "p5", "p7"]


def test_bad_pages():
    for page in ({}, {"order": ["a"], "posts": {"a": {"id": "b"}}}, {"order": ["a"], "posts": {"a": {"id": "a", "create_at": -1}}}):
        with pytest.raises(paged.InvalidPage):
            paged.page_rows(page)
    with pytest.raises(ValueError):
        paged.page_window(since=1, before="x")


def test_download_names(tmp_path):
    assert downloads.safe_name("../a/b\\c:d.txt") == "c_d.txt" and downloads.safe_name("..") == "file"
    assert downloads.unique_names(["a.txt", "A.txt", "x/a.txt"]) == ["a.txt", "A-2.txt", "a-3.txt"]
    assert downloads.place_under(str(tmp_path), "a").endswith("/a")
    for bad in ("../x", "", "/etc/passwd"):
        with pytest.raises(ValueError):
            downloads.place_under(str(tmp_path), bad)


FIXTURE = {
    "schemaVersion": 1,
    "name": "own",
    "conversations": [{"id": "c"}],
    "posts": [
        {"id": "t1", "conversationId": "c", "userId": "a", "createAt": 1, "message": "Payment evidence for PAY-1 is missing here"},
        {"id": "t1b", "rootId": "t1", "conversationId": "c", "userId": "b", "createAt": 2, "message": "approved"},
        {"id": "t2", "conversationId": "c", "userId": "a", "createAt": 3, "message": "Deploy of the gateway was late on Friday"},
        {"id": "t3", "conversationId": "c", "userId": "a", "createAt": 4, "message": "Lunch on Friday"},
    ],
    "cases": [
        {"id": "one", "subject": "payment evidence", "queries": ["payment", "evidence"], "expectedThreads": [{"threadId": "t1", "grade": 2}]},
        {"id": "two", "subject": "gateway", "queries": ["gateway", "friday"], "expectedThreads": [{"threadId": "t2", "grade": 2}, {"threadId": "t3", "grade": 1}]},
    ],
}


def test_benchmark_floors(spark, tmp_path):
    build = lambda posts: PostIndex(spark, str(tmp_path), 2).build(posts)
    got = benchmark.means(benchmark.run(spark, benchmark.load_fixture(json.dumps(FIXTURE)), search, prepare=build)).first()
    assert got["recall"] >= 0.85 and got["rr"] >= 0.8 and got["ndcg"] >= 0.8


@pytest.mark.parametrize("harm", [{"schemaVersion": 2}, {"conversations": []}, {"posts": FIXTURE["posts"][1:]}, {"cases": FIXTURE["cases"] * 2}])
def test_bad_fixtures(harm):
    with pytest.raises(benchmark.InvalidFixture):
        benchmark.load_fixture(json.dumps({**FIXTURE, **harm}))


def test_all_cases_run_in_one_plan(spark, tmp_path):
    fixture = benchmark.load_fixture(json.dumps({**FIXTURE, "cases": [*FIXTURE["cases"], {"id": "none", "subject": "gateway", "queries": [], "expectedThreads": [{"threadId": "t1", "grade": 1}]}]}))
    posts = benchmark.fixture_posts(spark, fixture)
    index = PostIndex(spark, str(tmp_path), 2).build(posts)
    rows = benchmark.ranked(index, fixture)
    got = {r["case"]: r for r in benchmark.report(rows, posts, spark.createDataFrame([("a", "ann")], "id string, username string")).collect()}
    assert (got["one"]["recall"], got["one"]["rr"], got["one"]["irrelevant"], got["one"]["budget_before"]) == (1.0, 1.0, 0, 0)
    assert got["two"]["recall"] == 1.0 and got["none"]["recall"] == 0.0 and got["none"]["irrelevant"] == 1
    assert got["none"]["budget_before"] == len("ann") + 24 + len("Deploy of the gateway was late on Friday")
    assert all(r["stable"] for r in benchmark.stable(rows, benchmark.ranked(index, fixture)).collect())
    assert {r["case"]: r["stable"] for r in benchmark.stable(rows, rows.where("case <> 'two' OR rank > 1")).collect()} == {"one": True, "two": False, "none": True}
