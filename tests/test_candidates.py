"""Candidates after changes: lost matches, kept labels, merged states, and probes that point nowhere."""

from weft.functions.subjects import Probe, probe
from weft.plans import reevaluate as R

POSTS = "id string, thread_id string, create_at bigint, update_at bigint, delete_at bigint, message string"


def test_an_edit_takes_a_match_away(spark):
    probes = R.probe_table(spark, {"A-1": [Probe("big gateway", "generic", (), ("big", "gateway")), Probe("a (b) c", "generic", ())], "B-2": [Probe("proj-12", "generic", (), ("proj-12",))]})
    candidates = spark.createDataFrame([("A-1", "t1", ["exact_phrase", "routing_scopes", "morphology_match"]), ("A-1", "t2", ["all_terms_in_thread"]), ("A-1", "t3", ["direct_post", "exact_phrase"]), ("B-2", "t1", ["latest_activity"]), ("B-2", "t4", [])], "request string, thread_id string, reasons array<string>")
    posts = [("t1", "t1", 1, 1, 0, "Big things"), ("p2", "t1", 2, 9, 0, "the GATEWAY, PROJ-12."), ("p3", "t1", 3, 3, 0, "biggateway"), ("t2", "t2", 1, 1, 0, "big"), ("p5", "t2", 2, 2, 7, "gateway"), ("t3", "t3", 1, 1, 0, "an a (b) c"), ("t4", "t4", 1, 1, 0, "proj-123")]
    got = {(r["request"], r["thread_id"]): (r["reasons"], r["matching_ids"], r["latest_activity_at"], r["stays"]) for r in R.reevaluated(candidates, spark.createDataFrame(posts, POSTS), probes).collect()}
    assert got == {
        ("A-1", "t1"): (["routing_scopes", "all_terms_in_thread"], ["p2", "t1"], 9, True),
        ("A-1", "t2"): ([], [], 7, False),
        ("A-1", "t3"): (["direct_post", "exact_phrase", "exact_phrase_in_root", "all_terms_in_thread"], ["t3"], 1, True),
        ("B-2", "t1"): (["latest_activity", "all_terms_in_thread"], ["p2"], 9, True),
        ("B-2", "t4"): ([], [], 1, False),
    }


def test_merged_states_lose_nothing(spark):
    ddl = "request string, thread_id string, reasons array<string>, matching_ids array<string>, fusion double"
    a = spark.createDataFrame([("r", "t", ["rank_fusion", "exact_phrase"], ["p1"], 0.2), ("r", "u", [], [], 0.1)], ddl)
    b = spark.createDataFrame([("r", "t", ["remote_search"], ["p2", "p1"], 0.5), ("s", "t", ["remote_search"], ["p9"], 0.3)], ddl)
    assert sorted(tuple(r) for r in R.merged(a, b).collect()) == [("r", "t", ["exact_phrase", "rank_fusion", "remote_search"], ["p1", "p2"], 0.5), ("r", "u", [], [], 0.1), ("s", "t", ["remote_search"], ["p9"], 0.3)]


def test_noisy_probes():
    assert [R.noisy(p) for p in (probe("api"), probe("proxy"), probe("v2-ab"), probe("gateway"), probe("ab cd"), probe("ab gateway"), probe('"the api" x'), probe('"late gateway"'), Probe("ok"), Probe("okay then"))] == [True, True, False, False, True, False, False, False, True, False]
