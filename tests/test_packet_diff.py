from weft.operators import packet_diff as P

SCHEMA = "k string, n int, observed_at long, s struct<a: string, `b.c`: array<struct<x: int, age_seconds: int>>>, m map<string, int>"


def test_leaves_and_changes(spark):
    before = spark.createDataFrame([("p", 1, 10, ("q", [(1, 5), (None, 6)]), {"u": 1, "v": 2}), ("r", None, 1, None, None), ("gone", 1, 1, ("z", []), {})], SCHEMA)
    after = spark.createDataFrame([("p", 1, 99, ("Q", [(1, 7)]), {"v": 3, "w": 1}), ("r", None, 2, (None, None), None), ("new", 2, 1, None, {})], SCHEMA)
    flat = {r["path"]: r["value"] for r in P.flattened(before.where("k = 'p'"), ["k"]).collect()}
    assert flat == {"n": "1", "observed_at": P.MASK, "s.a": "q", "s.b.c[0].x": "1", "s.b.c[0].age_seconds": P.MASK, "s.b.c[1].x": None, "s.b.c[1].age_seconds": P.MASK, "m.u": "1", "m.v": "2"}
    got = {(r["k"], r["path"]): (r["before"], r["after"], r["change"]) for r in P.differences(before, after, ["k"]).collect()}
    assert {p: c for (k, p), c in got.items() if k == "p"} == {
        "s.a": ("q", "Q", "changed"), "s.b.c[1].x": (None, None, "removed"), "s.b.c[1].age_seconds": (P.MASK, None, "removed"), "m.u": ("1", None, "removed"), "m.v": ("2", "3", "changed"), "m.w": (None, "1", "added"),
    }
    assert {p: c[2] for (k, p), c in got.items() if k == "r"} == {"s": "removed", "s.a": "added", "s.b.c": "added"}
    assert {c[2] for (k, _), c in got.items() if k == "gone"} == {"removed"} and {c[2] for (k, _), c in got.items() if k == "new"} == {"added"}
    assert P.differences(before, before, ["k"]).count() == 0


def test_modes_show_their_own_paths(spark):
    rows = [("p", "total_posts", "changed"), ("p", "posts[0].id", "added"), ("p", "posts[3].signals.approved", "added"), ("p", "posts[1].create_at", "removed")]
    got = {r["mode"]: (r["added"], r["removed"], r["changed"]) for r in P.by_mode(spark.createDataFrame(rows, "k string, path string, change string"), ["k"]).collect()}
    assert len(P.MODES) == 9 and got == {
        "human": (0, 0, 1), "brief": (1, 1, 1), "timeline": (1, 1, 0), "agent": (1, 0, 1), "json": (1, 1, 1), "agent_signals": (2, 0, 1), "json_full_posts": (2, 1, 1), "agent_brief": (1, 0, 1), "agent_navigate": (1, 0, 1),
    }
