import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from weft.llm import class_ngrams
from weft.llm.class_ngrams import class_scores, exchange_classes

DATA = "/root/testdata/sf0.001"


def brute(rows):
    toks = {}
    for d, t in rows:
        toks[d] = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())] + [None]
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in toks}
    c = Counter(x for d in toks if not held[d] for x in toks[d])
    n, v = sum(c.values()), len(c)
    return {d: (held[d], len(t), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)) for d, t in toks.items()}


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def check(rows, df):
    got, want = {r["doc_id"]: r for r in df.collect()}, brute(rows)
    assert set(got) == set(want)
    for d, w in want.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert math.isclose(r["base_score"], w[4], rel_tol=1e-9, abs_tol=1e-9)
    return got


def test_whole_table_and_held_out_perplexity(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = check([tuple(r) for r in docs.select("doc_id", "text").collect()], class_scores(docs))
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got.values())


def test_edge_rows(spark):
    rows = [(1, None), (2, "a A b"), (3, "a"), (6, " \n"), (7, "é " * 20_000)]
    check(rows, class_scores(frame(spark, rows).selectExpr("*", "1 AS row", "2 AS kind")))
    rows = [(None, "a b"), (2, "a"), (2, "a")]
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in class_scores(frame(spark, rows)).collect()) == [("2", 2), ("2", 2), ("None", 3)]
    assert class_scores(frame(spark, [])).count() == 0


def test_exchange_finds_planted_classes():
    r = np.random.default_rng(3)
    n, k = 60, 4
    of = r.integers(0, k, n)
    pairs = np.array([[r.poisson(40 if of[b] == (of[a] + 1) % k else 0.3) for b in range(n)] for a in range(n)], float)
    found = exchange_classes(pairs, classes=k, sweeps=20)
    agree = sum(Counter(of[found == c]).most_common(1)[0][1] for c in set(found.tolist()))
    assert agree >= 0.9 * n


def test_scores_do_not_depend_on_partitions(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choices(["a", "b", "c", "d", "zz"], k=30))) for i in range(60)]
    a = {x["doc_id"]: round(x["score"], 9) for x in class_scores(frame(spark, rows, 1)).collect()}
    b = {x["doc_id"]: round(x["score"], 9) for x in class_scores(frame(spark, rows, 4)).collect()}
    assert a == b


def likelihood(table):
    f = class_ngrams._f
    return f(table).sum() - f(table.sum(0)).sum() - f(table.sum(1)).sum()


def test_placing_follows_the_likelihood():
    """Each word's class against moving it alone and counting anew."""
    r, k = np.random.default_rng(5), class_ngrams.CLASSES
    names, own = r.integers(0, 40, 3000), r.integers(0, 6, 40)

    def table(own):
        out = np.zeros((k, k))
        np.add.at(out, (own[names[:-1]], own[names[1:]]), 1)
        return out

    middle = np.arange(1, 2999)
    # Words at either end of the sequence have an occurrence with one neighbour only.
    words = [w for w in range(40) if w not in (names[0], names[-1])]
    at = middle[np.isin(names[middle], words)]
    at = at[np.argsort(names[at], kind="stable")]
    beside = lambda step: np.where(names[at + step] == names[at], k, own[names[at + step]])
    found = class_ngrams.place_words(np.searchsorted(words, names[at]), beside(-1), beside(1), own[words], table(own))
    for w, got in zip(words, found.tolist(), strict=True):
        best = [likelihood(table(np.where(np.arange(40) == w, c, own))) for c in range(k)]
        assert best[got] >= max(best) - 1e-6


def test_words_outside_the_core_get_classes_of_their_own(spark):
    """1,000 core words in two alternating kinds; rarer words of equal shape stand where the one or the other kind does."""
    r = random.Random(6)
    core = [[f"{c}{i:03d}x" for i in range(500)] for c in "mn"]
    rare = [[f"{c}{i:03d}x" for i in range(40)] for c in "pq"]
    rows = []
    for i in range(1500):
        words = [r.choice(core[j % 2]) for j in range(60)]
        for j in r.sample(range(60), 4):
            words[j] = r.choice(rare[j % 2])
        rows.append((i, " ".join(words)))
    n = 4
    docs = frame(spark, rows)
    placed, _ = class_ngrams.place(docs, class_ngrams.vocabulary_table(docs, n), n)
    own = {}
    for row in placed.collect():
        words, _, _, classes = class_ngrams.unpack(row["blob"], class_ngrams._PLACED_TYPES)
        own |= dict(zip(words.tolist(), classes.tolist(), strict=True))

    def classes(kind):
        import pyarrow as pa

        hashes = class_ngrams.tokens(*class_ngrams.as_bytes(pa.array([" ".join(kind)])))[0][:-1]
        return {own[w] for w in hashes.tolist()}

    assert not classes(rare[0]) & classes(rare[1])


def plain_classes(texts, order):
    """Exchange in plain Python: every move is judged by the likelihood counted anew."""
    k = class_ngrams.CLASSES
    pairs = Counter(p for t in texts for p in zip([None, *t], t))
    seen = Counter(w for p, n in pairs.items() for w in p for _ in range(n))
    units = sorted(order, key=lambda w: -seen[w])
    own = {w: i % k for i, w in enumerate(units)}

    def table(own):
        out = np.zeros((k, k))
        for (a, b), n in pairs.items():
            out[own[a], own[b]] += n
        return out

    moved = True
    while moved:
        moved = False
        for w in units:
            if not seen[w]:
                continue
            gain = [likelihood(table({**own, w: c})) for c in range(k)]
            if max(gain) > gain[own[w]] + 1e-6:
                own[w] = int(np.argmax(gain))
                moved = True
    return own, table(own)


def test_score_against_a_plain_class_model(spark):
    """All words are common enough for the core, so classes come from exchange alone."""
    r = random.Random(12)
    kinds = [[f"{c}{i}" for i in range(4)] for c in "abc"]
    rows = [(i, " ".join(r.choice(kinds[j % 3]) for j in range(r.randint(6, 30)))) for i in range(60)]
    docs = frame(spark, rows)
    got = {x["doc_id"]: x["score"] for x in class_scores(docs).collect()}
    texts = {d: [*t.split(), None] for d, t in rows}
    train = [t for d, t in texts.items() if zlib.crc32(str(d).encode()) % 5 != 1]

    import pyarrow as pa

    words = sorted({w for t in texts.values() for w in t[:-1]})
    hashes = class_ngrams.tokens(*class_ngrams.as_bytes(pa.array([" ".join(words)])))[0][:-1]
    order = [words[i] for i in np.argsort(hashes)] + [None]  # units are numbered by hash, the end comes last
    own, table = plain_classes(train, order)
    count = Counter(w for t in train for w in t)
    often = table.sum(0)
    share = (often + 0.5) / (often.sum() + 0.5 * class_ngrams.CLASSES)
    size, kinds_of = Counter(), Counter()
    for w, n in count.items():
        size[own[w]] += n
        kinds_of[own[w]] += 1
    for d, t in texts.items():
        want, before = 0.0, own[None]
        for w in t:
            c = own[w]
            want += math.log10((table[before, c] + class_ngrams.BACK_OFF * share[c]) / (table[before].sum() + class_ngrams.BACK_OFF))
            want += math.log10((count[w] + 0.5) / (size[c] + 0.5 * (kinds_of[c] + 1)))
            before = c
        assert math.isclose(got[d], want, rel_tol=1e-9), d


def test_the_most_frequent_are_exactly_the_top(spark, monkeypatch):
    """Ties beyond the bound are cut by hash, never by whole grades of counts."""
    monkeypatch.setattr(class_ngrams, "TOP", 7)
    rows = [(i, " ".join(f"w{j}" for j in range(20)) + " often" * 3) for i in range(30)]
    words, counts, _ = class_ngrams.most_frequent(class_ngrams.vocabulary_table(frame(spark, rows), 4))
    assert len(words) == 7 and counts[0] > counts[1] and len(set(counts[1:].tolist())) == 1
