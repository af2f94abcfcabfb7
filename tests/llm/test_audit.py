import random
import re
from itertools import permutations

import numpy as np
import pytest

from tests.oracle import differences
from weft.llm.filter_audit import FILTERS, orders, subset_counts, survivors, text_failures, with_labels, with_repeats
from weft.llm.q_audit import LOST, OP13_SQL, op13_filter_audit


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_audit_equals_sql(spark, size):
    assert differences(spark, op13_filter_audit, OP13_SQL, f"/root/testdata/{size}")[:3] == []


def audit(docs, labels):
    judged = with_labels(with_repeats(text_failures(docs), 4), labels, "doc_id", list(LOST))
    return orders(survivors(judged, 5, list(LOST)), FILTERS, LOST)


def brute(rows, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    docs = []
    for key, text, part in rows:
        t = text or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = key is not None and any(k is not None and k < key and (u or "") == t for k, u, _ in rows)
        docs.append((part or "", {f for f, x in fails.items() if x}, key in good and key is not None, key in toxic and key is not None))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        gone = {}
        for order in permutations(FILTERS):
            left = mine
            for step, f in enumerate(order):
                lost = [d for d in left if f in d[1]]
                before = len([d for d in mine if f in d[1]]) - len(lost)
                left = [d for d in left if f not in d[1]]
                gone[f] = gone.get(f, 0) + len(lost)
                out[part, "".join(order), step + 1] = [len(left), len(lost), before, sum(d[1] == {f} for d in mine), sum(d[2] for d in lost), sum(d[3] for d in lost)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(gone[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_edge_rows_equal_brute_force(spark):
    r = random.Random(11)
    texts = [None, "", " \n", "a " * 49, "Aa b c " * 20, "#", "x" * 200_000, " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(60)), "É é " * 40, "one two|three " * 30]
    rows = [(r.choice([None, 1, 2, 3, 4, 5, 6, 7, 8]), r.choice(texts), r.choice([None, "", "s", "t"])) for _ in range(300)]
    labels = [(1, 1, 0), (1, 0, 1), (2, None, 1), (3, 1, None), (None, 1, 1), (99, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS fails", "2 AS part", "3 AS id", "4 AS t1").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS labels", "2 AS id")
    got = {(x["part"], x["filter_order"], x["step"]): tuple(x[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for x in audit(docs, marks).collect()}
    assert len(got) == 3 * 600 and got == brute(rows, labels)
    assert audit(docs.limit(0), marks).count() == 0
    assert audit(docs, marks.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_bitmaps_equal_plain_counts():
    rng = np.random.default_rng(2)
    code, fails, labels = rng.integers(0, 7, 1000), rng.integers(0, 8, 1000), rng.integers(0, 4, 1000)
    got = subset_counts(code, 7, fails, labels, 3, 2)
    for p in range(7):
        for s in range(8):
            alive = (code == p) & (fails & s == 0)
            assert got[p, :, s].tolist() == [alive.sum(), (alive & (labels & 1 > 0)).sum(), (alive & (labels & 2 > 0)).sum()]
