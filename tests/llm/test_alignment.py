import hashlib
import random
from collections import Counter

import pytest

from weft.llm.alignment import SIZES, align, align_documents, encode_pieces, gathered, group_sizes, lengthened, shortened
from weft.llm.q_alignment import op11_token_alignment
from weft.llm.vocabularies import vocabulary

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def byte_alphabet():
    """Characters that byte-level BPE shows for bytes: those that show stand for themselves, the others come from U+0100 on."""
    shows = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shows]
    return {chr(b): b for b in shows} | {chr(256 + i): b for i, b in enumerate(hidden)}


@pytest.fixture(scope="module")
def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary(A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=vocabulary(B))
    of = byte_alphabet()

    def run(text):
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        return (x, [bytes(of[c] for c in a.id_to_token(i)) for i in x]), (y, [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y])

    return run


def brute(rows, encoders):
    found = []
    for key, text in rows:
        (x, xs), (y, ys) = encoders(text or "")
        want = (" " + (text or "")).encode()
        if not text or b"".join(xs) != want or b"".join(ys) != want:
            found.append((key, [], [], [], ""))
            continue
        ends = []
        for parts in (xs, ys):
            own, n = [], 0
            for p in parts:
                n += len(p)
                own.append(n)
            ends.append(own)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        names, last = [], 0
        for c in cuts:
            side = [",".join(str(i) for i, e in zip(ids, own, strict=True) if last < e <= c) for ids, own in ((x, ends[0]), (y, ends[1]))]
            names.append("|".join(side))
            last = c
        links, j = [], 0
        for i, e in enumerate(ends[0]):
            s = e - len(xs[i])
            while ends[1][j] <= s:
                j += 1
            k = j
            while k < len(y) and ends[1][k] - len(ys[k]) < e:
                links.append((x[i], y[k]))
                k += 1
        found.append((key, x, y, links, ";".join(names)))
    counts = Counter(link for f in found for link in f[3])
    most: dict[int, int] = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    return sorted(
        ((key, len(x), len(y), names.count("|"), len(links), sum(counts[l] == most[l[1]] for l in links), sum(counts[l] for l in links), hashlib.sha256(names.encode()).hexdigest() if links else "") for key, x, y, links, names in found),
        key=repr,
    )


def answers(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_random_texts_equal_brute_force(spark, encoders):
    r = random.Random(3)
    parts = ["word", "Ünïcode", "'s", "'ll", " ", "  ", "   ", "\n", "\t", " ", "　", " ", "\x1c", "\x85", "漢字", "日本", "🙂", "é", "<|endoftext|>", "<s>", "<0x41>", "</s>", "123", "4", ",", "...", "☃", "\x00", "aaaaaaaa", "ﬁ", "Ā"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(1, 25)))) for i in range(400)]
    rows += [(1000 + i, x) for i, x in enumerate([None, "", " ", "  ", "a ", " a", "▁", "a ▁b", "x" * 3000, "ab" * 2000 + " c", "\n a", "a  b", "a  b"])]
    rows += [(5, "word one"), (5, "word one"), (None, "word, two"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_a", "2 AS key", "3 AS slice", "'x' AS groups").repartition(3)
    assert answers(align_documents(df, vocabulary(A), vocabulary(B))) == brute(rows, encoders)


def test_edge_tables(spark):
    assert answers(align_documents(spark.createDataFrame([], "doc_id long, text string"), vocabulary(A), vocabulary(B))) == []
    df = spark.createDataFrame([("k", None), ("l", "")], "`the.key` string, `the text` string")
    assert answers(align_documents(df, vocabulary(A), vocabulary(B), "the.key", "the text")) == [("k", 0, 0, 0, 0, 0, 0, ""), ("l", 0, 0, 0, 0, 0, 0, "")]


def packed(ids, sizes):
    return [i * SIZES + n for i, n in zip(ids, sizes, strict=True)]


def test_numbers_travel_short():
    import numpy as np

    for x in ([], [0, 65534], [65535, 1, 4_000_000_000, 65534]):
        assert lengthened(shortened(np.array(x, np.int64)), len(x)).tolist() == x


def test_rows_of_an_alignment(spark):
    tokens = spark.createDataFrame([(7, 1, packed([1, 2, 3], [2, 2, 3]), packed([9, 8, 7], [1, 3, 3]))], "id long, n long, a array<int>, b array<int>")
    out = align(tokens)
    assert [tuple(r)[2:] for r in out.orderBy("end").collect()] == [(1, None, 9, 1, 9, 0), (2, 1, None, 1, 8, 0), (4, 2, 8, 2, 8, 0), (7, 3, 7, 3, 7, 1)]
    (row,) = gathered(out).collect()
    assert tuple(row)[:-1] == (7, 1, 3, 3, 2, 4, "1,2|9,8;3|7") and [tuple(x) for x in row["links"]] == [(1, 9), (1, 8), (2, 8), (3, 7)]


def test_an_id_is_dealt_out_once(spark):
    tokens = spark.createDataFrame([(7, 1, packed([1], [2]), packed([9], [2]))], "id long, n long, a array<int>, b array<int>")
    plan = gathered(align(tokens))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == plan.count("REPARTITION_BY_COL") == 1


def test_sizes_are_read_from_groups():
    import pyarrow as pa

    many = ["1,2|9,8;3|7", "", "5|6,7,8;1,2,3|4"] * 60_000  # more than is looked at together
    assert [x[-3:].tolist() for x in group_sizes(pa.array(many))] == [[3, 0, 4], [3, 0, 4], [2, 0, 2], [4, 0, 6]]
    assert [x.tolist() for x in group_sizes(pa.array(["1,2|9,8;3|7", "", "5|6,7,8;1,2,3|4"]))] == [[3, 0, 4], [3, 0, 4], [2, 0, 2], [4, 0, 6]]


def test_pieces_equal_whole_texts(spark, encoders):
    df = spark.createDataFrame([(1, 3, "naïve<s>")], "id long, n long, piece string")
    (row,) = encode_pieces(df, vocabulary(A), vocabulary(B)).collect()
    (x, xs), (y, ys) = encoders("naïve<s>")
    assert (row["a"], row["b"], row["n"]) == (packed(x, map(len, xs)), packed(y, map(len, ys)), 3)


def test_pieces_of_a_slice_take_little_memory():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from weft.llm.alignment import _sliced

    words = np.array([b"a ", b"bc ", b"de, ", b"f. "])[np.random.default_rng(2).integers(0, 4, 2_000_000)].tolist()
    texts = [b"".join(words[i : i + 20_000]).decode() for i in range(0, len(words), 20_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["key", "text"])
    run = _sliced(vocabulary(B))
    list(run(iter([batch.slice(0, 1)])))  # tables that stay
    tracemalloc.start()
    (out,) = run(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(out.column("times")[0].as_py()) == sum(out.column("counts")[0].as_py()) > 1_900_000
    assert peak < 96 << 20


def shuffled_rows(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_pieces_and_answers_travel_in_packed_rows(spark, encoders):
    r = random.Random(5)
    words = ["".join(r.choice("abcdeéfgh'") for _ in range(r.randint(1, 9))) + "x" for _ in range(400)]
    words = list(dict.fromkeys(words))
    texts = [r.sample(words, len(words)) for _ in range(32)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    df = df.repartitionById(32, df["doc_id"])  # a slice each
    before = shuffled_rows(spark)
    assert answers(align_documents(df, vocabulary(A), vocabulary(B))) == brute(rows, encoders)
    # A row for each piece of each slice would be more than this on every way.
    assert shuffled_rows(spark) - before < sum(map(len, texts))


def test_columns_are_squeezed():
    import numpy as np

    from weft.llm.exchange import opened, squeezed

    columns = [np.array([1, 70_000, 2**32 - 1], np.uint32), np.array([], np.int64), np.array([-5, 2**62], np.int64), np.frombuffer(b"abc", np.uint8)]
    assert [x.tolist() for x in opened(squeezed(columns), ["u4", "i8", "i8", "u1"])] == [x.tolist() for x in columns]
    assert len(squeezed([np.arange(1 << 16, dtype=np.int64)])) < 3 << 16


@pytest.mark.parametrize("size", ["sf0.001"])
def test_query_over_the_whole_table(spark, encoders, size):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{size}/documents.parquet").select("doc_id", "text").collect()]
    assert answers(op11_token_alignment(spark, f"/root/testdata/{size}")) == brute(rows, encoders)
