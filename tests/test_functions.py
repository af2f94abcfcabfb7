import io
import zipfile

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weft.functions import subjects as Q
from weft.functions import text as T
from weft.plans import evidence, packing
from weft.sources import attachments as A


@pytest.mark.parametrize(
    "text, kind, value",
    [("PROJ-12", "ticket", "PROJ-12"), ("proj-12", "ticket", "PROJ-12"), ("https://h/t/pl/" + "a1" * 13, "post", "a1" * 13), ("b2" * 13, "post", "b2" * 13), ("payment evidence", "text", "payment evidence")],
)
def test_subjects(text, kind, value):
    assert Q.classify(text) == Q.Subject(kind, value)


def test_bad_subjects():
    for args in ((None,), (" ",), ("x", "no ticket")):
        with pytest.raises(Q.InvalidSubject):
            Q.classify(*args)


def test_probes_and_requests():
    p = Q.probe('deploy "still unclear" of the API gateway')
    assert p.phrases == ("still unclear",) and p.terms == ("deploy", "api", "gateway")
    assert Q.requests(p)[0] == ("exact_phrase", "still unclear") and ("broad_fts", "deploy api gateway") in Q.requests(p)
    assert Q.requests(Q.probe("api")) == [("exact_phrase", "api"), ("term_fts", "api")]
    kinds = [p.kind for p in Q.resolve(Q.Subject("text", "src/a.py"), ["b"], [("src/a.py", "file_path")])]
    assert kinds == ["file_path", "generic"]


def test_expansions():
    assert Q.mixed_script("сервиc") == "сервис" and Q.mixed_script("plain") is None
    assert Q.other_layout("ghbdtn") == "привет" and Q.other_layout("hello") is None
    assert Q.transliterate("oshibka") == "ошибка" and Q.transliterate("panel") is None
    assert ("deploy", "release", "synonym") in Q.expansions(["deploy"], [["deploy", "release"]])


def test_dates():
    assert Q.filter_date("2024-01-01") == 1_704_067_200_000 == Q.filter_date("2024-01-01T01:00:00+01:00")
    for bad in (("2024-01-01T00:00:00", None), ("2024-01-02", "2024-01-01")):
        with pytest.raises(ValueError):
            Q.filter_dates(*bad)


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_text_functions(spark):
    assert one(spark, T.normalize, "ＡЁ") == "a" + "е"
    assert one(spark, T.ticket_keys, "эPROJ-12 see https://kibana.x/ab-2020 https://jira.x/y/OPS-3 ops-3 PROJ-2") == ["OPS-3", "PROJ-12", "PROJ-2"]
    assert one(spark, T.redact, "Password: hunter2, api_key=abc Bearer abcdefghij") == "Password: [REDACTED] api_key: [REDACTED] Bearer [REDACTED]"
    assert one(spark, T.sentences, "One. Two?\n  ") == ["One.", " Two?", "\n"]
    assert one(spark, lambda c: T.contains_exact(c, "a-b"), "x a-b y") and not one(spark, lambda c: T.contains_exact(c, "a-b"), "xa-by")
    assert one(spark, lambda c: T.trigram_similarity(c, "approved", 2), "aproved") == pytest.approx(2 * 4 / 11)
    assert {(e["kind"], e["value"]) for e in one(spark, T.entities, "see https://a.b/c. `foo.bar` PR #12 E_FAIL @bob deadbeef1")} >= {("url", "https://a.b/c"), ("symbol", "foo.bar"), ("pull_request", "PR #12"), ("error_code", "E_FAIL"), ("username", "bob"), ("commit", "deadbeef1")}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(1, 60)), min_size=1, max_size=25), st.integers(1, 300))
def test_greedy_packing_keeps_the_budget(posts, budget):
    rows = pd.DataFrame([("t", f"p{i}", i + 1, p, u) for i, (p, u) in enumerate(posts)], columns=["thread_id", "id", "pos", "priority", "units"])
    out = packing.choose(rows, budget)
    used = int(out.loc[out["selected"], "units"].sum())
    assert used <= budget
    assert not ((~out["selected"]) & (out["units"] <= budget - used)).any()


def test_next_steps():
    assert [s["step"] for s in evidence.next_steps({"adequacy": "thin", "currency": "stale", "omitted": 5, "posts": 10})] == ["widen", "sync", "full_thread"]
    assert evidence.next_steps({"adequacy": "decided", "currency": "current"}) == []


def workbook(rows):
    cells = "".join(f"<row>{''.join(f'<c r=\"{chr(65 + j)}{i + 1}\" t=\"inlineStr\"><is><t>{v}</t></is></c>' for j, v in enumerate(r))}</row>" for i, r in enumerate(rows))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


def test_attachment_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\ntwo\nthree")
    (tmp_path / "b.bin").write_bytes(b"a\0b")
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe")
    got = {r["path"][-5:]: (r["status"], r["preview"]) for r in A.text_preview(A.read_files(spark, str(tmp_path))).collect()}
    assert got == {"a.txt": ("text", "one\ntwo\nthree"), "b.bin": ("binary", None), "c.txt": ("invalid_utf8", None)}
    df = spark.createDataFrame([("x", bytearray(workbook([["name", "password"], ["bob", "pw"], ["a@b.co", "z"]]))), ("y", bytearray(b"no zip"))], "path string, content binary")
    out = {r["path"]: r for r in A.workbook_preview(df.union(spark.createDataFrame([("z", None)], "path string, content binary"))).collect()}
    assert (out["z"]["status"], out["z"]["rows"]) == ("too_large", None)
    assert out["x"]["rows"] == '[["name", "password"], ["bob", "[REDACTED]"], ["[EMAIL]", "[REDACTED]"]]' and out["y"]["status"] == "unreadable: BadZipFile"


def test_delimited():
    assert A.parse_delimited('a,"b ""x"",\n2"\nc,d\n') == ([["a", 'b "x",\n2'], ["c", "d"]], True)
    assert A.parse_delimited('a,"open')[1] is False
    assert [A.column_index(c) for c in ("A", "Z", "AA")] == [0, 25, 26]


def test_every_kind_of_entity(spark):
    text = "see https://github.com/acme/tool/pull/3, https://h/t/pl/abcdefghij0123456789abcdef repo: core/api service billing in src/app/main.py with @scope/pkg and run_it( x"
    got = {(e["kind"], e["value"]) for e in one(spark, T.entities, text)}
    assert got >= {("url", "https://github.com/acme/tool/pull/3"), ("permalink", "https://h/t/pl/abcdefghij0123456789abcdef"), ("repository", "acme/tool"), ("repository", "core/api"), ("service", "billing"), ("file_path", "src/app/main.py"), ("package", "@scope/pkg"), ("symbol", "run_it")}
    assert "это" in T.STOP_WORDS and len(T.STOP_WORDS) == len(set(T.STOP_WORDS))


def test_large_files_have_a_row_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(A, "MOST_FILE", 10)
    (tmp_path / "a.txt").write_text("short")
    (tmp_path / "b.txt").write_text("longer than the bound")
    got = {r["path"][-5:]: (r["status"], r["preview"]) for r in A.text_preview(A.read_files(spark, str(tmp_path))).collect()}
    assert got == {"a.txt": ("text", "short"), "b.txt": ("too_large", None)}
