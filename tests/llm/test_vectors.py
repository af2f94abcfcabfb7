import numpy as np
import pytest

from weft.llm import vector_links
from weft.llm.q_vectors import op12_cosine_links
from weft.llm.quantiser import Quantiser
from weft.llm.vector_links import cosine_links, least_connected, least_hashed

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.95):
    """(links, component) of each row; rows of (id, vector or None)."""
    groups: dict[int, list[int]] = {}
    for i, (key, v) in enumerate(rows):
        if key is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            groups.setdefault(len(v), []).append(i)
    links, up = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for own in groups.values():
        x = np.array([rows[i][1] for i in own], np.float64)
        u = x / np.linalg.norm(x, axis=1)[:, None]
        for a, b in zip(*np.nonzero(np.triu(u @ u.T >= threshold, 1)), strict=True):
            links[own[a]] += 1
            links[own[b]] += 1
            up[root(own[a])] = root(own[b])
    least: dict[int, int] = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return sorted(((key, links[i], None if key is None else least[root(i)]) for i, (key, _) in enumerate(rows)), key=repr)


def answers(df, **kw):
    out = cosine_links(df, **kw).collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in out), key=repr)


def planted(n=1500, d=32, seed=5):
    """Random vectors, groups of near copies around some of them, one large group, exact copies."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    for k in range(0, 300, 3):
        x[k + 1] = x[k] + rng.normal(size=d) * 0.15
        x[k + 2] = x[k] + rng.normal(size=d) * 0.3
    x[400:700] = x[399] + rng.normal(size=(300, d)) * 0.1
    x[700:800] = x[399]
    ids = rng.permutation(n)
    return [(int(i), [float(c) for c in v], 0) for i, v in zip(ids, x, strict=True)]


def test_links_equal_brute_force(spark, monkeypatch):
    rows = planted()
    want = brute([r[:2] for r in rows])
    for size in ((256, 512, 1024), (16, 20, 30)):  # one list and few cells; many lists, hot ones in blocks and shards
        for name, value in zip(("LIST", "BLOCK", "SHARD"), size, strict=True):
            monkeypatch.setattr(vector_links, name, value)
        got = answers(spark.createDataFrame(rows, SCHEMA).repartition(5))
        assert sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want)  # none below the threshold is counted
        assert all(g[0] == w[0] and g[1] <= w[1] for g, w in zip(got, want, strict=True))
        assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.99 * len(want)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    a, b = [1.0, 2.0, 0.5], [1.0, 2.0, 0.6]
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0, -0.0], 0), (4, [1.0, None, 2.0], 0), (5, [1.0, nan, 2.0], 0), (6, [inf, 1.0, 1.0], 0)]
    rows += [(9, a, 1), (9, a, 2), (8, b, 1), (7, [-x for x in a], 1), (None, a, 0), (None, None, 0), (10, a + [0.0], 1), (11, a + [0.0], 1), (12, [3.0], 0), (13, [1e-30], 0), (14, [0.0, 5.0], 0), (15, [-0.0, 1.0], 0)]
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").selectExpr("*", "1 AS n_links", "2 AS node", "3 AS v", "4 AS kept")
        assert answers(df) == brute([r[:2] for r in rows])
    assert answers(spark.createDataFrame([], SCHEMA)) == []
    huge = [(1, [1e300, 1e300], 0), (2, [1e-300, 1.1e-300], 0)]
    assert answers(spark.createDataFrame(huge, "vec_id long, embedding array<double>, label int")) == [(1, 1, 1), (2, 1, 1)]


def test_names_of_any_kind(spark):
    df = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.1])], "`the.id` string, `e.v` array<double>")
    assert sorted(tuple(r) for r in cosine_links(df, "the.id", "e.v").collect()) == [("a", 1, "a", True), ("b", 1, "a", False)]


def test_codes_bound_distances_from_below():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 20))
    x /= np.linalg.norm(x, axis=1)[:, None]
    model = Quantiser.fit(x, 4)
    own, margins = model.margins(x)
    assert (margins >= -1e-9).all() and (margins[np.arange(600), own] == 0).all()
    codes, rest = model.encode(x, own)
    for at in range(4):
        mine = own == at
        far = np.linalg.norm(x[:, None] - x[None, mine], axis=2)
        assert (np.sqrt(np.maximum(model.distances(x, at, codes[mine]), 0)) - rest[mine] <= far + 1e-3).all()


def test_a_fit_holds_few_distances():
    import tracemalloc

    x = np.random.default_rng(1).normal(size=(20_000, 8))
    tracemalloc.start()
    own = Quantiser.fit(x, 2000).margins(x[:50])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(own) == 50 and peak < 160 << 20  # all distances at once are 320 MB


def test_the_sample_is_cut_before_its_sort(spark):
    rows = spark.range(40_000).selectExpr("cast(id AS string) AS v").repartition(8)
    got = least_hashed(rows, 40_000, 500)
    assert [r["v"] for r in got.collect()] == [r["v"] for r in rows.selectExpr("v", "xxhash64(v) AS h").orderBy("h", "v").limit(500).collect()]
    assert least_hashed(rows, 40_000, 50_000).count() == 40_000
    filters = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x]
    assert len(filters) == 1 and "xxhash64" in filters[0]


def test_components_of_a_cell():
    node = np.array([3, 5, 8, 9, 12, 20])
    assert least_connected(node, np.array([4, 2, 1]), np.array([2, 1, 5])).tolist() == [3, 5, 5, 9, 5, 5]


@pytest.mark.parametrize("size", ["sf0.01"])
def test_query_over_the_whole_table(spark, size):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in op12_cosine_links(spark, f"/root/testdata/{size}").collect()), key=repr)
    assert got == brute(rows)
