import random
import re

import pytest

from weft.llm.components import components
from weft.llm.jaccard_groups import jaccard_components, keep_one_of_each

DATA = "/root/testdata/sf0.001"


def brute(rows):
    sets, up = {}, {}
    for d, t in rows:
        w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        up[d] = d

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert got(jaccard_components(docs)) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("seed", [3, 4])
def test_near_copies_about_the_threshold(spark, seed):
    r = random.Random(seed)
    bases = [r.choices([f"W{i}" for i in range(300)], k=60) for _ in range(8)]
    rows = []
    for i in range(250):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            w[r.randrange(60)] = f"x{r.randint(0, 20)}"
        rows.append((i, None if i % 37 == 0 else " ".join(w[: r.choice([60, 60, 57, 50, 5, 4, 1])])))
    assert got(jaccard_components(frame(spark, rows))) == brute(rows)


def test_large_group_of_near_copies(spark):
    r = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(700):
        w = list(base)
        w[r.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(w)))
    assert {c for _, c in got(jaccard_components(frame(spark, rows))).values()} == {0}


def test_edge_rows(spark):
    rows = [(3, "a b c d e"), (7, "A B C D E"), (7, "A B C D E"), (8, None), (9, " \n"), (10, "a b"), (11, "a  b"), (None, "a b"), (12, "a b c")]
    found = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard_components(frame(spark, rows)).collect())
    assert found == sorted([("3", 1, "3"), ("7", 1, "3"), ("7", 1, "3"), ("8", 0, "8"), ("9", 0, "9"), ("10", 1, "10"), ("11", 1, "10"), ("None", 1, "None"), ("12", 1, "12")])
    assert jaccard_components(frame(spark, [])).count() == 0


def test_one_of_each_stays_with_all_columns(spark):
    df = frame(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, None)]).selectExpr("doc_id", "text", "doc_id AS id", "1 AS n")
    out = keep_one_of_each(df)
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3, 4] and set(out.columns) == set(df.columns)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r["node"]: r["component"] for r in components(edges, "a", "b").collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_rows_of_one_id_are_told_apart_by_their_texts(spark):
    rows = [(1, "a b c d e f"), (7, "a b c d e f"), (7, "u v w x y z")]
    assert sorted((r["doc_id"], r["text"]) for r in keep_one_of_each(frame(spark, rows)).collect()) == [(1, "a b c d e f"), (7, "u v w x y z")]


def test_string_keys_and_odd_columns(spark):
    df = frame(spark, [(1, "a b c d e f"), (2, "A b c d e f"), (3, "q")]).selectExpr("concat('k', doc_id) AS `my.id`", "text", "1 AS t", "2 AS least")
    found = {r["my.id"]: r["component_id"] for r in jaccard_components(df, "my.id").collect()}
    assert found == {"k1": "k1", "k2": "k1", "k3": "k3"}
    out = keep_one_of_each(df, "my.id")
    assert sorted(r["my.id"] for r in out.collect()) == ["k1", "k3"] and out.columns == df.columns


def test_a_frequent_key_is_dealt_out_by_salt(spark, monkeypatch):
    """All documents share one least token; many batches have leaders of it, and links still join all near copies."""
    from weft.llm import jaccard_groups

    monkeypatch.setattr(jaccard_groups, "SALTED", 2)
    r = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(400):
        w = list(base)
        w[r.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(w)))
    assert got(jaccard_components(frame(spark, rows, 16))) == brute(rows)


def test_a_repeated_row_stays_once(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text)] * 40 + [(2, text), (3, "a b c"), (3, "a b c"), (3, "another text"), (4, None), (4, None), (4, ""), (None, text), (None, text)]
    got = sorted(((r["my.id"], r["the text"]) for r in keep_one_of_each(frame(spark, rows).toDF("my.id", "the text"), "my.id", "the text").collect()), key=repr)
    assert got == sorted([(1, text), (3, "a b c"), (3, "another text"), (4, None), (4, ""), (None, text), (None, text)], key=repr)
