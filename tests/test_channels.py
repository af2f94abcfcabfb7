"""Channels over the stored index against a plain BM25, and the strong and weak passes."""

import math
import re

import pytest

from weft.functions.subjects import Probe, probe
from weft.operators.index import PostIndex
from weft.plans import channels

DDL = "id string, root_id string, thread_id string, conversation_id string, user_id string, create_at bigint, update_at bigint, delete_at bigint, message string"
TEXTS = [
    "deploy failed on the gateway", "gateway deploy was fine", "the rollout of proj-12 failed", "proj 12 and more", "настройки платежей сломались", "платёж не прошёл", "unrelated words here", "deployment notes", "on the gateway", "gatewayy typo",
]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = [(f"p{i}", "", f"t{i // 2}", f"c{i % 2}", "u", i, i, 0, t) for i, t in enumerate(TEXTS)]
    return PostIndex(spark, str(tmp_path_factory.mktemp("index")), 4, {"outage": ["not reachable", "unrelated words"]}).build(spark.createDataFrame(rows, DDL))


def tokens(t):
    return re.findall(r"[^\W_]+", t.lower())


def plain(query, mode):
    docs = [tokens(t) for t in TEXTS]
    average = sum(map(len, docs)) / len(docs)
    out = {}
    for q in [query] if mode == "phrase" else query:
        q = q if isinstance(q, list) else [q]
        tf = [sum(d[i : i + len(q)] == q for i in range(len(d))) for d in docs]
        n = sum(x > 0 for x in tf)
        idf = math.log((len(docs) - n + 0.5) / (n + 0.5))
        for i, f in enumerate(tf):
            if f:
                s, k = out.get(i, (0.0, 0))
                out[i] = (s - max(idf, 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(docs[i]) / average)), k + 1) if idf > 0 else (s - 1e-6 * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(docs[i]) / average)), k + 1)
    need = len(query) if mode == "all" else 1
    return {f"p{i}": s for i, (s, k) in out.items() if k >= need or mode == "phrase"}


@pytest.mark.parametrize("channel, value, want", [("term_fts", "gateway", plain(["gateway"], "any")), ("strict_fts", "deploy gateway", plain(["deploy", "gateway"], "all")), ("broad_fts", "deploy failed", plain(["deploy", "failed"], "any")), ("exact_phrase", "the gateway", plain(["the", "gateway"], "phrase")), ("term_fts", "proj-12", plain(["proj", "12"], "phrase"))])
def test_channels_equal_a_plain_bm25(index, channel, value, want):
    rows = channels.run(index, [channels.Request(0, 0, channel, channel, value)]).collect()
    got = {r["id"]: r["score"] for r in rows}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in got)
    assert [r["id"] for r in sorted(rows, key=lambda r: r["rank"])] == sorted(got, key=lambda i: (round(got[i], 12), -int(i[1:])))


def test_stems_concepts_prefixes_and_typos_are_found(index):
    find = lambda channel, value: {r["id"] for r in channels.run(index, [channels.Request(0, 0, channel, channel, value)]).collect()}
    assert find("morph_fts", channels.stems.token_stem("платежом")) == {"p4", "p5"}
    assert find("concept_fts", "outage") == {"p6"}
    assert find("prefix_fts", "depl") == {"p0", "p1", "p7"} and find("prefix_fts", "dep") == set()
    assert "p9" in find("trigram", "gateway") and find("trigram", "gw") == set()


def test_the_weak_pass_asks_only_for_uncovered_terms(index):
    probes = [probe("gateway nullword"), Probe("vpn", "generic", (), ("vpn",), (("vpn", "tunnel", "synonym"),))]
    strong = channels.strong_requests(probes)
    covered = channels.coverage(strong, {r["request"] for r in channels.run(index, strong).collect()}, probes)
    assert covered == {0: {"gateway"}}
    weak = channels.weak_requests(probes, covered, first=len(strong))
    assert {(r.channel, r.source, r.value) for r in weak} == {("trigram", "trigram", "nullword"), ("term_fts", "synonym", "tunnel")}
    assert channels.retrieve(index, probes, strong_ticket=True).where("source = 'synonym'").count() == 0


def test_contributions_keep_the_best_request_of_a_source(index):
    hits = channels.run(index, channels.strong_requests([probe("deploy gateway")]))
    rows = channels.contributions(hits).collect()
    assert len({(r["thread_id"], r["probe"], r["source"]) for r in rows}) == len(rows)
    assert all(math.isclose(r["score"], channels.retrieval.WEIGHTS[r["source"]] / (60 + r["rank"])) for r in rows)
    fused = {r["thread_id"]: r for r in channels.fusion(channels.contributions(hits)).collect()}
    assert math.isclose(fused["t0"]["fusion"], sum(r["score"] for r in rows if r["thread_id"] == "t0")) and "strict_fts" in fused["t0"]["sources"]


def test_an_empty_scope_finds_nothing(spark, index):
    empty = spark.createDataFrame([], "id string")
    assert channels.run(index, channels.strong_requests([probe("gateway")]), empty).count() == 0


def test_remote_candidates(spark):
    rows = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (0, 3, "a"), (1, 1, "b"), (1, 30, "c")], "probe int, rank int, thread_id string")
    assert [(r["thread_id"], round(r["fusion"], 6)) for r in channels.remote(rows).collect()] == [("b", round(1 / 62 + 1 / 61, 6)), ("a", round(1 / 61, 6))]
