import hashlib
import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from weft.llm.best_fit import best_fit_packing, pieces, plan  # noqa: E402
from weft.llm.piece_bpe import digest_documents, encode_documents, model  # noqa: E402
from weft.llm.token_counts import attribute, token_counts  # noqa: E402
from weft.llm.word_ids import word_ids  # noqa: E402

DATA = "/root/testdata/sf0.001"
PIECES, WORDS, RANKS = (public_tokenizers.path(x) for x in ("piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_50k.tiktoken"))


def frame(spark, rows, parts=2):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def test_pieces_equal_the_library():
    sp, own, r = sentencepiece.SentencePieceProcessor(model_file=PIECES), model(PIECES), random.Random(1)
    texts = ["", " ", "  ", "▁", " a", "a▁b", "\n\n", "x" * 5000]
    texts += ["".join(r.choice("abc theing  \n\t▁é①😀ﬁ#=-*0123ÀñЖ的\x00") for _ in range(r.randint(1, 60))) for _ in range(1500)]
    texts += ["".join(r.choices("aeiouthnsr ingERIONL#=/*.-_0123", k=r.randint(1, 300))) for _ in range(500)]
    for t in texts:
        ids = sp.encode(t, add_bos=True, add_eos=True)
        assert own.encode(t).tolist() == ids and own.decode(np.array(ids)) == sp.decode(ids)


def test_decoding_of_any_ids_equals_the_library():
    sp, own, r = sentencepiece.SentencePieceProcessor(model_file=PIECES), model(PIECES), random.Random(2)
    for _ in range(400):
        ids = [r.randint(3, 258) if r.random() < 0.7 else r.randint(259, 31_999) for _ in range(12)]
        assert own.decode(np.array(ids)) == sp.decode(ids)


def test_piece_digests_of_rows(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = [(1, "hello  world"), (1, "hello  world"), (2, None), (None, ""), (3, "é " * 50_000)]
    for r in digest_documents(frame(spark, rows).selectExpr("*", "1 AS ids"), PIECES).collect():
        text = next(t or "" for d, t in rows if d == r["doc_id"])
        ids = sp.encode(text, add_bos=True, add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert digest_documents(frame(spark, []), PIECES).count() == 0
    assert encode_documents(frame(spark, [(1, "ab")]), PIECES).first()["decoded"] == "ab"


def test_word_ids_equal_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    texts = ["", "  \x01 a", "ΑΣ Σ ΑΣ Β", "a\x01b c", "<|endoftext|> x", "x <|endoftext|> y", "a<|startoftext|><|endoftext|>B's", "<|endoftext|", "<|EndOfText|>", "é ́", "don't we'll\x85x", "The the THE."] * 2
    got = word_ids(WORDS).encode([x.encode() for x in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_word_units_equal_the_library():
    import random

    from tokenizers import Tokenizer

    from weft.llm.word_ids import WordIds

    t, r = Tokenizer.from_file(WORDS), random.Random(4)
    chars = [*map(chr, range(0x21, 0x100)), *"abcABCéÉßÿ´·ªºµ×÷'<|>09", "İ", "Σ", "ς", "\u0301", "ﬁ", "\u2003", "漢", "🙂", "²", "½", "\xad"]
    words = ["".join(r.choice(chars) for _ in range(r.randint(1, 12))) for _ in range(4000)] + ["<|endoftext|>", "a<|endoftext|>b", "<|x", "I'll", "Straße123", "E\u0301"]
    of = WordIds(WORDS)
    for texts in ([" ".join(words[i : i + 7]) for i in range(0, len(words), 7)], words):  # new words, then known ones and units
        assert [np.frombuffer(g, "<u4").tolist() for g in of.encode([x.encode() for x in texts])] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    other = WordIds(WORDS)
    other.merges = None  # a tokenizer of another pattern goes the whole way
    assert other.encode([x.encode() for x in words]) == of.encode([x.encode() for x in words])


def test_distinct_units_are_merged_once():
    from weft.llm.word_ids import WordIds

    of, asked = WordIds(WORDS), []
    learn = of._learn_units
    of._learn_units = lambda units: asked.extend(units) or learn(units)
    of.encode(["Straße, straße. (STRASSE) Strasse!".encode(), "straße (strasse, straße!".encode()])
    assert sorted(asked) == sorted(["straße", "strasse", ",", ".", "(", ")", "!"])


def test_words_of_known_units_are_not_learned():
    """A word in other case or with other signs was once an entry of its own, split in Python."""
    from tokenizers import Tokenizer

    from weft.llm.word_ids import WordIds

    t, of, asked = Tokenizer.from_file(WORDS), WordIds(WORDS), []
    of.encode(["straße alpha. 1 ( ) , !".encode()])
    learn = of._learn
    of._learn = lambda new, into: asked.extend(new) or learn(new, into)
    texts = ["STRASSE, (alpha) Straße! 11 ALPHA1.", "(Alpha,straße.STRAßE)", "", " ", "alpha's"]
    ids = of.encode([x.encode() for x in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert sorted(asked) == [b"alpha's", b"strasse"]
    assert sum(len(x) for x in vars(of).values() if isinstance(x, dict)) == 10


def test_units_end_where_texts_end():
    from tokenizers import Tokenizer

    from weft.llm.word_ids import WordIds

    t, of, r = Tokenizer.from_file(WORDS), WordIds(WORDS), random.Random(5)
    texts = ["ABC<", "|d", "a<", "|endoftext|>", "É", "é", "1", "1", "", "×x", "x×", "÷", "'", "s", "x", "'S"]
    texts += ["".join(r.choices("aBÉß×'<|.,19 \n\x1c\x85\xa0漢", k=r.randint(0, 9))) for _ in range(6000)]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in of.encode([x.encode() for x in texts])] == want
    assert of.encode([]) == [] and of.encode([b"", b" "]) == [b"", b""]
    of.merges = None
    assert [np.frombuffer(x, "<u4").tolist() for x in WordIds.encode(of, [x.encode() for x in texts])] == want


def test_a_task_leaves_only_words_that_recurred(spark, monkeypatch):
    """Workers are kept from stage to stage; a task over many words once left all of them behind."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    from weft.llm import word_ids as module

    monkeypatch.setattr(module, "_made", {})
    docs = frame(spark, [])
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    words = ["".join("abcdefghijklmnopqrst"[i // 20**k % 20] for k in range(5)) for i in range(260_000)]
    text = lambda some: pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([" ".join(some)])], ["doc_id", "text"])
    rows = [r for b in pieces(docs, WORDS)(iter([text(words), text(words[:1000])])) for r in b.to_pylist()]
    of, t, asked = module.word_ids(WORDS), Tokenizer.from_file(WORDS), []
    assert sum(len(x) for x in vars(of).values() if isinstance(x, dict)) <= 2 * 120_000
    learn = of._learn
    monkeypatch.setattr(of, "_learn", lambda new, into: asked.extend(new) or learn(new, into))
    ids = [np.frombuffer(x, "<u4").tolist() for x in of.encode([b" ".join(w.encode() for w in words[a : a + 1000]) for a in (0, 1000)])]
    assert ids == [t.encode(" ".join(words[a : a + 1000]), add_special_tokens=False).ids for a in (0, 1000)]
    assert sorted(asked) == sorted(w.encode() for w in words[1000:2000])
    assert rows[-1]["length"] == len(ids[0]) + 1 - rows[-1]["start"]


@pytest.mark.parametrize("counts", [{}, {5: 1}, {2047: 3, 1: 2}, {1024: 5}, {700: 10, 600: 4, 48: 9}, {1: 5000}])
def test_plan_places_every_piece_once(counts):
    placed, bins = {}, 0
    for chosen, n in plan(counts):
        assert sum(length * k for length, k in chosen) <= 2048 and n > 0
        bins += n
        for length, k in chosen:
            placed[length] = placed.get(length, 0) + k * n
    assert placed == counts
    assert bins >= -(-sum(n * c for n, c in counts.items()) // 2048)


def check_packing(df, docs, capacity):
    by = {}
    for r in df:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_of_the_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = best_fit_packing(docs, WORDS).collect()
    n = check_packing(rows, docs, 2048)
    assert n <= 1.02 * -(-sum(r["length"] for r in rows) // 2048) + 1
    assert {(r["doc_id"], r["piece"]) for r in rows} == {(r["doc_id"], r["piece"]) for r in pieces(docs, WORDS).collect()}


def test_packing_edge_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "a b"), (3, "word " * 3000), (4, "word " * 2047)]
    got = best_fit_packing(frame(spark, rows).selectExpr("*", "1 AS length", "2 AS salt"), WORDS).collect()
    check_packing(got, rows, 2048)
    assert sorted(r["length"] for r in got) == [1, 1, 1, 3, 953, 2048, 2048]
    assert best_fit_packing(frame(spark, []), WORDS).count() == 0


def test_tokens_go_where_they_begin():
    counts, crossing = attribute(np.array([2, 5, 7]), np.array([3, 3, 7]))
    assert counts.tolist() == [2, 0, 1] and crossing.tolist() == [1, 0, 0]


def test_section_counts_against_brute_force(spark):
    import base64

    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(1, "a b\n\n\nc é\nlast"), (2, None), (3, "\n"), (4, "x\n \n y"), (None, "one")]
    got = {}
    for r in token_counts(frame(spark, rows), RANKS, public_tokenizers.PATTERN).collect():
        got.setdefault(r["doc_id"], {})[r["section"]] = r["n_tokens"]
    for d, t in rows:
        raw, want, at = (t or "").encode(), {}, 0
        for token in enc.encode_ordinary(t or ""):
            section = raw[:at].count(b"\n")
            want[section] = want.get(section, 0) + 1
            at += len(enc.decode_single_token_bytes(token))
        assert {k: v for k, v in got[d].items() if v} == want
    assert token_counts(frame(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_sections_may_be_given_by_offsets(spark):
    df = spark.createDataFrame([(1, "aa bb cc", [2, 5]), (2, "aa", [9, 1, None]), (3, None, None)], "doc_id long, text string, ends array<long>")
    got = {}
    for r in token_counts(df, RANKS, public_tokenizers.PATTERN, sections="ends").collect():
        got.setdefault(r["doc_id"], []).append((r["section"], r["start_byte"], r["n_bytes"], r["n_tokens"], r["doc_tokens"]))
    assert [x[1:3] for x in sorted(got[1])] == [(0, 2), (2, 3), (5, 3)] and sum(x[3] for x in got[1]) == got[1][0][4] > 2
    assert [x[1:3] for x in sorted(got[2])] == [(0, 2), (2, 0), (2, 0)] and got[3] == [(0, 0, 0, 0, 0)]


def test_names_with_dots(spark):
    from weft.llm.piece_bpe import digest_documents
    from weft.llm.quality_rules import quality_rules

    df = spark.createDataFrame([(1, "some text")], "`my.id` long, `the.text` string")
    assert digest_documents(df, PIECES, "my.id", "the.text").first()["my.id"] == 1
    assert quality_rules(df, "the.text").first()["n_words"] == 2
