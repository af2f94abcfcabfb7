import hashlib
import random

import numpy as np

from weft.llm.fingerprints import likeness, near_duplicates, signatures, with_next
from weft.llm.textcore import as_bytes, bucket_of, ngrams


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def of(*texts):
    import pyarrow as pa

    return signatures(*as_bytes(pa.array(texts)))


def test_edits_against_brute_force(spark):
    r = random.Random(4)
    rows = [(i * 7, r.choice([None, "", "é" * r.randint(1, 50), " ".join(r.choices(["ab", "Cd", "ñ"], k=r.randint(1, 200)))])) for i in range(120)]
    order = sorted(rows, key=lambda x: -x[0])
    got = {x["doc_id"]: x for x in with_next(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(order):
        t, following = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + following[:k]
        assert (got[d]["n_chars"], got[d]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, e, n = of(t, edited, following)
        assert got[d]["near_edited"] == likeness(a, e) and got[d]["near_next"] == likeness(a, n)
        assert (got[d]["fingerprint"] == got[d]["edited_fingerprint"]) == bool((a == e).all())


def test_edge_rows(spark):
    assert with_next(frame(spark, [])).count() == 0
    one = with_next(frame(spark, [(1, "a b c")]).selectExpr("*", "1 AS part", "2 AS id")).first()
    assert one["near_next"] == 1.0
    rows = [(None, "x"), (3, None), (3, None), (5, "abcdef"), (5, "zz")]
    assert sorted(str(r["doc_id"]) for r in with_next(frame(spark, rows)).collect()) == ["3", "3", "5", "5", "None"]


def test_likeness_estimates_jaccard():
    r = random.Random(1)
    a = r.choices([f"w{i}" for i in range(5000)], k=2000)
    b = a[:1333] + r.choices([f"v{i}" for i in range(5000)], k=667)
    x, y = of(" ".join(a), " ".join(b))
    assert abs(likeness(x, y) - 0.5) < 0.13
    assert likeness(*of("A B c", "a b C")) == 1 and likeness(*of("a b c", "a b")) < 0.1


def test_slices_do_not_change_fingerprints():
    text = " ".join(f"w{i % 977}" for i in range(900_000))
    assert (of(text, "short one")[0] == of("short one", text)[1]).all()


def test_near_duplicate_classes(spark):
    r = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    near = list(base)
    near[100] = "x"
    rows = [(10, " ".join(base)), (11, " ".join(base)), (12, " ".join(near)), (13, " ".join(r.choices(base, k=200))), (14, None), (15, ""), (None, " ".join(base))]
    got = {x["doc_id"]: (x["class_id"], x["n_links"]) for x in near_duplicates(frame(spark, rows)).collect()}
    assert got == {10: (10, 1), 11: (10, 1), 12: (10, 1), 13: (13, 0), 14: (14, 0), 15: (15, 0), None: (None, 0)}


def test_pairs_meet_past_a_smaller_id(spark):
    """In the buckets of three near documents, among templates of lower ids, all three pairs are compared and count as links."""
    base = [f"w{i}" for i in range(300)]

    def edited(name, places):
        return " ".join(f"{name}{i}" if i in places else w for i, w in enumerate(base))

    own = range(0, 80, 10)
    rows = [(i, edited(f"t{i}x", range(i % 7, 300, 13))) for i in range(1, 41)]
    rows += [(100, edited("q", own)), (101, edited("q", [*own, 150])), (102, edited("q", [*own, 210]))]
    got = {x["doc_id"]: (x["class_id"], x["n_links"]) for x in near_duplicates(frame(spark, rows)).collect()}
    assert {d: got[d] for d in (100, 101, 102)} == {d: (100, 2) for d in (100, 101, 102)}


def test_buckets_equal_sparks(spark):
    ids = [0, 1, -5, 2**40, -(2**62)]
    rows = spark.createDataFrame([(i,) for i in ids], "i long").selectExpr("i", "pmod(xxhash64(i), 7) AS b").collect()
    assert {r["i"]: r["b"] for r in rows} == dict(zip(ids, bucket_of(np.array(ids), 7).tolist(), strict=True))


def test_ngrams_depend_on_their_words_alone():
    words = np.random.default_rng(1).integers(1, 2**63, 100, dtype=np.uint64)
    for k in (1, 2, 5, 8, 13, 20):
        whole = ngrams(words, k)
        assert len(whole) == 101 - k
        assert all(ngrams(words[i : i + k].copy(), k)[0] == whole[i] for i in range(0, 101 - k, 7))
        assert len(np.unique(whole)) == len(whole)


def test_recall_of_classes_against_the_exact_join(spark):
    from weft.llm.jaccard_groups import jaccard_components

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    found = {r["doc_id"]: r["class_id"] for r in near_duplicates(docs).collect()}
    exact = {r["doc_id"]: r["component_id"] for r in jaccard_components(docs).collect()}
    linked = [d for d, c in exact.items() if c != d]
    assert linked and sum(found[d] == exact[d] for d in linked) >= 0.9 * len(linked)
    assert all(exact[d] == exact[c] for d, c in found.items())


def test_a_hot_band_bucket_goes_through_the_exact_search(spark, monkeypatch):
    from weft.llm import fingerprints

    monkeypatch.setattr(fingerprints, "BUCKET", 4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        w[(i * 7) % 120] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows.append((99, "quite another text of some more words"))
    got = {x["doc_id"]: x["class_id"] for x in near_duplicates(frame(spark, rows)).collect()}
    assert {got[i] for i in range(60)} == {0} and got[99] == 99
