import hashlib
import random
import re

import numpy as np
import pytest

from weft.llm.substring_dedup import ANCHOR, digest_kept, factors, parse_block, remove_repeats, segments
from weft.llm.textcore import hash_words, ngrams, spans

DATA = "/root/testdata/sf0.001"


def brute(rows):
    """Word by word: every 20-word sequence is kept in a set, in order of (doc_id, start)."""
    seen, out = set(), {}
    for d, t in sorted(set(rows), key=lambda r: r[0]):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            key = tuple(w[p : p + 20])
            if key in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(key)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def got(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()}


def test_whole_table_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert got(digest_kept(spark.read.parquet(f"{DATA}/documents.parquet"))) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_periodic_and_shared_passages(spark, seed):
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(80):
        words = r.choices(["a", "b"], k=r.randint(0, 50)) + (passage[r.randint(0, 30) :] if i % 3 == 0 else []) + ["c"] * r.randint(0, 45)
        rows.append((i, None if i % 19 == 0 else " \t\n".join(words)))
    assert got(digest_kept(frame(spark, rows))) == brute(rows)


def test_one_segment_that_repeats_far_apart(spark):
    """An 8-word phrase at short gaps can be the anchor of a whole document, whose windows repeat 27 words on."""
    rows = []
    for i in range(200):
        line = " ".join(f"d{i}p{k}" for k in range(8))
        rows.append((i, "\n".join(f"{line} d{i}x{x}" for x in "ABC" * 4)))
    assert got(digest_kept(frame(spark, rows))) == brute(rows)


def test_edge_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (2, text), (3, None), (4, ""), (None, text)]
    found = [tuple(r) for r in digest_kept(frame(spark, rows)).select("doc_id", "n_words", "n_removed").collect()]
    assert sorted(found, key=str) == sorted([(1, 40, 0), (1, 40, 0), (2, 40, 40), (3, 0, 0), (4, 0, 0), (None, 40, 0)], key=str)
    assert digest_kept(frame(spark, [])).count() == 0


def test_same_id_with_other_text_is_another_document(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (1, b), (2, b)]
    found = sorted(tuple(r) for r in digest_kept(frame(spark, rows)).select("doc_id", "n_removed").collect())
    assert found == [(1, 0), (1, 0), (2, 30)]


def test_very_long_text(spark):
    long = " ".join(f"x{i}" for i in range(200_000))
    assert got(digest_kept(frame(spark, [(1, long), (2, long + " end")])))[2][1] == 200_000


def test_texts_are_cut_and_columns_kept(spark):
    text = "\n".join(f"w{i}" for i in range(25))
    df = frame(spark, [(1, text), (2, "start " + text + " stop"), (3, text)]).selectExpr("doc_id", "text", "'k' AS kind", "doc_id AS id", "1 AS bucket")
    out = {r["doc_id"]: r for r in remove_repeats(df, drop_emptied=True).collect()}
    assert out[1]["text"] == text and out[2]["text"] == "start stop" and 3 not in out
    assert out[2]["kind"] == "k" and out[2]["id"] == 2 and out[2]["bucket"] == 1
    assert remove_repeats(df).where("doc_id = 3").first()["text"] == ""


def test_factors_name_their_source(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = factors(frame(spark, [(5, text), (9, "q " + text)])).collect()
    assert {(r["doc_id"], r["source_doc_id"]) for r in rows} == {(9, 5)}
    covered = set()
    for r in rows:
        assert r["start"] - r["source_start"] == 1 and r["n_words"] >= 20
        covered |= set(range(r["start"], r["start"] + r["n_words"]))
    assert covered == set(range(1, 31))


def test_many_different_windows_of_one_anchor():
    """300,000 windows with one phrase of small hash: 32 bits would take some ten pairs of them for equal."""
    r = np.random.default_rng(8)
    pool = [f"w{i}" for i in r.integers(0, 10**6, 10**6).tolist()]
    raw = np.frombuffer(" ".join(pool).encode(), np.uint8)
    start, end, _ = spans(raw, np.array([0, len(raw)]))
    least = int(np.argmin(ngrams(hash_words(raw, start, end, lower=False), ANCHOR)))
    phrase, n = " ".join(pool[least : least + ANCHOR]), 300_000
    texts = [f"{phrase} " + " ".join(f"u{i}" for i in range(12 * k, 12 * k + 12)) for k in range(n)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    row, anchor, at, lengths, symbols = segments(raw, np.append(0, np.cumsum([len(t) for t in texts])))
    assert len(symbols) == n and np.unique(anchor, return_counts=True)[1].max() > 0.99 * n
    assert not len(parse_block(anchor, row, at, lengths, symbols)[0])


def test_one_symbol_under_two_anchors():
    anchor, doc = np.array([1, 2, 1, 2], np.uint64), np.array([1, 2, 3, 4])
    zero, one = np.zeros(4, np.int64), np.ones(4, np.int64)
    found = parse_block(anchor, doc, zero, one, np.full(4, 9, np.uint64))
    assert sorted(zip(found[0].tolist(), found[3].tolist(), strict=True)) == [(3, 1), (4, 2)]


def test_a_longer_later_source_beats_the_earliest():
    """Windows 5 and 6 stand in documents 1 and 2; only document 2 has them in one run with 7."""
    anchor = np.full(4, 3, np.uint64)
    doc, at = np.array([1, 2, 3, 4]), np.array([0, 0, 0, 0])
    lengths = np.array([2, 3, 4, 2])
    symbols = np.array([5, 6, 5, 6, 7, 9, 5, 6, 7, 6, 7], np.uint64)
    got = sorted(zip(*(x.tolist() for x in parse_block(anchor, doc, at, lengths, symbols)), strict=True))
    step = 1 << 24
    assert got == [(2, 0, 2, 1, 0), (3, step, 3, 2, 0), (4, 0, 2, 2, step)]


def plain_parse(segments_):
    """Greedy parsing word by word: segments are (doc, at, symbols) in order."""
    out = []
    for k, (doc, at, own) in enumerate(segments_):
        p = 0
        while p < len(own):
            best = (0, None, None)
            for d, a, other in segments_[: k + 1]:
                for q in range(len(other)):
                    if (d, a + q) >= (doc, at + p):
                        continue
                    n = 0
                    while p + n < len(own) and q + n < len(other) and own[p + n] == other[q + n]:
                        n += 1
                    if n > best[0]:
                        best = (n, d, a + q)
            if best[0]:
                out.append((doc, at + p, *best))
            p += max(best[0], 1)
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_factors_of_a_block_equal_a_plain_greedy_parse(seed):
    r = np.random.default_rng(seed)
    lengths = r.integers(1, 17, 30)
    symbols = r.integers(0, 4, int(lengths.sum())).astype(np.uint64)
    doc, at = np.arange(30) // 2, np.where(np.arange(30) % 2, 40, 0)
    cuts = np.split(symbols, np.cumsum(lengths)[:-1])
    want = plain_parse([(int(d), int(a), c.tolist()) for d, a, c in zip(doc, at, cuts, strict=True)])
    order = r.permutation(30)
    got = parse_block(np.full(30, 8, np.uint64), doc[order], at[order] << 24, lengths[order], np.concatenate([cuts[i] for i in order]))
    assert sorted(zip(got[0].tolist(), (got[1] >> 24).tolist(), got[2].tolist(), got[3].tolist(), (got[4] >> 24).tolist(), strict=True)) == want


def test_a_block_that_is_too_large_is_dealt_out_again(spark, monkeypatch):
    """A phrase within ever new words fills one block; windows then meet by their symbols."""
    from weft.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 2000)
    r = random.Random(5)
    phrase = [f"p{i}" for i in range(24)]
    rows = [(i, " ".join([f"a{r.randint(0, 9)}" for _ in range(8)] + phrase + [f"b{r.randint(0, 9)}" for _ in range(8)])) for i in range(300)]
    assert got(digest_kept(frame(spark, rows))) == brute(rows)


def test_keys_and_columns_of_any_name(spark):
    text = " ".join(f"w{i}" for i in range(25))
    df = frame(spark, [(1, text), (2, text)]).selectExpr("cast(doc_id AS int) AS doc_id", "text", "'k' AS `a.b`", "7 AS row", "8 AS kind")
    out = {r["doc_id"]: r for r in remove_repeats(df).collect()}
    assert out[1]["text"] == text and out[2]["text"] == "" and out[2]["a.b"] == "k" and out[2]["row"] == 7
    with pytest.raises(TypeError):
        remove_repeats(df.selectExpr("cast(doc_id AS string) AS doc_id", "text"))
