import re
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_encoding import check_packing  # noqa: E402
from tests.llm.test_jaccard import brute as components  # noqa: E402
from tests.oracle import DATA, connect  # noqa: E402
from weft.llm.q_quality import OP8_SQL  # noqa: E402
from weft.llm.vocabularies import vocabulary  # noqa: E402


def brute():
    """{doc_id: text} that the first three stages leave, in plain Python over the whole table."""
    con = connect(DATA)
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({OP8_SQL}) WHERE kept").fetchall()}
    docs = sorted((d, t) for d, t in con.execute("SELECT doc_id, text FROM documents").fetchall() if d in kept)
    root = components(docs)
    docs = [(d, t) for d, t in docs if root[d][1] == d]
    seen, out = set(), {}
    for d, t in docs:
        places = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        words = [t[a:b] for a, b in places]
        gone = [False] * len(words)
        for p in range(len(words) - 19):
            key = tuple(words[p : p + 20])
            if key in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(key)
        if words and all(gone):
            continue
        text, at = "", 0
        for i, (a, b) in enumerate(places):
            end = places[i + 1][0] if i + 1 < len(places) else len(t)
            text += t[at:a] if i == 0 else ""
            text += "" if gone[i] else t[a:end]
        out[d] = text if places else t
    return out


def test_stages_are_four_and_registered():
    import __spark_entry__

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "substring dedup", "best-fit packing"]
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run


def test_run_equals_brute_force(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = set()
    for d, text in brute().items():
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        for p, s in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[s : s + 2048], "<u4")
            want.add((d, p, s, len(part), zlib.crc32(part.tobytes())))
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    assert check_packing(rows, None, 2048) <= 1.03 * -(-sum(r["length"] for r in rows) // 2048) + 1


def test_stages_keep_columns_and_take_empty_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), DATA).columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), DATA).count() == 0


def test_edge_rows_go_through_all_stages(spark, tmp_path):
    """Null texts and ids, repeated ids and rows, a very long text, and columns named like measures or scratch."""
    words = [f"the{i} of and word{i}" for i in range(40)]
    text, other = " ".join(words), " ".join(reversed(words))
    long = " ".join(f"the of long{i}" for i in range(40_000))
    rows = [(1, text), (1, text), (2, text), (3, None), (4, ""), (5, other), (5, long), (6, long + " more"), (None, " ".join(f"to be null{i}" for i in range(60)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "length(text) AS n_chars", "7 AS n_words", "8 AS kept", "9 AS `my.t`", "10 AS bucket")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs, left = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left.append(sorted((r["doc_id"] for r in docs.collect()), key=repr))
        if name != "best-fit packing":
            assert docs.columns == df.columns and all((r["n_words"], r["kept"], r["my.t"], r["bucket"]) == (7, 8, 9, 10) for r in docs.collect())
    assert left[0] == sorted([1, 1, 2, 5, 5, 6, None], key=repr)
    assert left[1] == left[2] == sorted([1, 5, 5, None], key=repr)
    assert set(left[3]) == {1, 5, None}
