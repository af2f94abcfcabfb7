import base64
import hashlib
import json
import random

import pytest

from tests.oracle import differences
from weft.llm.chat_format import escape, format_conversations, parse_turn, read_back, unescape
from weft.llm.q_chat import OP7_SQL, op7_chat_formatting
from weft.llm.q_quality import OP8_SQL, op8_quality_rules
from weft.llm.quality_rules import quality_rules
from weft.llm.warc import InvalidArchive, build_archive, build_record, parse_record, read_archive, read_records, write_archives


def frame(spark, rows, schema, parts=2):
    return spark.createDataFrame(rows, schema).repartition(parts)


# --- quality rules


def test_rules_equal_sql(spark):
    assert differences(spark, op8_quality_rules, OP8_SQL)[:3] == []


def test_measures_against_brute_force(spark):
    import re

    r = random.Random(7)
    rows = [(i, None if i % 11 == 0 else "".join(r.choice(["a ", "b ", "the ", "X\n", "#\t", "é ", "\n"]) for _ in range(r.randint(0, 80)))) for i in range(150)]
    rows.append((999, "word " * 30_000))
    for x in quality_rules(frame(spark, rows, "doc_id long, text string")).collect():
        t = rows[x["doc_id"]][1] or "" if x["doc_id"] < 999 else rows[-1][1]
        w = [y for y in re.split(r"[\x20\x09-\x0D]+", t) if y]
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        from collections import Counter

        often = Counter(grams)
        covered = {p for i, g in enumerate(grams) if often[g] > 1 for p in range(i, i + 8)}
        lines = [y for y in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == want
        assert x["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and (not x["kept"] or not x["base_failed"])


def test_rules_on_edge_rows(spark):
    df = frame(spark, [(1, None), (1, None), (None, "a")], "doc_id long, text string").selectExpr("*", "1 AS n_words", "2 AS h")
    assert all(not r["kept"] and r["h"] == 2 for r in quality_rules(df).collect())
    assert quality_rules(df.limit(0)).count() == 0


# --- chat formatting


def test_chat_equals_sql(spark):
    assert differences(spark, op7_chat_formatting, OP7_SQL)[:3] == []


def test_escaping_is_reversible():
    r = random.Random(3)
    for _ in range(500):
        t = "".join(r.choice(["<", "|", ">", "&", "lt;", "amp;", "turn", "<|end|>", "é"]) for _ in range(r.randint(0, 12)))
        assert unescape(escape(t)) == t and "<" not in escape(t)


TURNS = "conv_id long, turn long, role string, text string, parts string"


def test_parts_become_ordered_placeholders(spark):
    parts = json.dumps([{"type": "text", "text": "see <|image:9|>"}, {"type": "image", "ref": "a.png", "width": 1024, "height": 600}, {"type": "audio", "ref": "b", "seconds": 2.5}, {"type": "text", "text": "!"}])
    more = json.dumps([{"type": "document", "ref": "c.pdf", "pages": 3}])
    df = format_conversations(frame(spark, [(1, 1, "assistant", None, more), (1, 0, "user", None, parts)], TURNS), parts="parts")
    a, b = df.orderBy("seq").collect()
    assert parse_turn(a["segment"]) == ("user", [("text", "see <|image:9|>"), ("image", 0), ("audio", 1), ("text", "!")])
    assert json.loads(a["attachments"]) == [{"number": 0, "type": "image", "ref": "a.png", "tokens": 1024}, {"number": 1, "type": "audio", "ref": "b", "tokens": 75}]
    assert a["expanded_tokens"] == 1099 and a["loss_chars"] == 0 and b["loss_chars"] == len("<|document:2|>")
    assert b["start"] == len(a["segment"]) and json.loads(b["attachments"])[0] == {"number": 2, "type": "document", "ref": "c.pdf", "tokens": 1800}


def test_chat_edge_rows(spark):
    rows = [(None, None, None, None, None), (2, 0, "assistant", None, None), (2, 0, "assistant", None, None), (3, 0, "assistant", "x" * 300_000, None), (3, 1, "a<|end|>", "<|turn|>", None)]
    out = {r["conv_id"]: r for r in read_back(format_conversations(frame(spark, rows, TURNS))).collect()}
    assert out[None]["n_turns"] == 1 and out[2]["n_turns"] == 2 and out[2]["loss_chars"] == 0 and out[3]["loss_chars"] == 300_000
    assert out[3]["turns_sha256"] == hashlib.sha256(("assistant\n" + "x" * 300_000 + "\na<|end|>\n<|turn|>\n").encode()).hexdigest()
    assert read_back(format_conversations(frame(spark, [], TURNS))).count() == 0
    for bad in ("", "<|turn|>a<|body|>b", "<|turn|>a<|body|>b<|end|>c", "<|turn|>a<|body|><|turn|><|end|>"):
        with pytest.raises(ValueError):
            parse_turn(bad)


# --- archives


def test_archives_against_brute_force(spark):
    r = random.Random(5)
    rows = [(i, None if i % 9 == 0 else f"http://x/{i}\r\né\\", r.choice([None, "", "same", f"<p>{i}</p>", "é" * 5000])) for i in range(300)]
    largest = {}
    for i, _, h in rows:
        largest[h or ""] = max(i, largest.get(h or "", -1))
    got = {x["page_id"]: x for x in read_records(write_archives(frame(spark, rows, "page_id long, url string, html string"))).collect()}
    assert len(got) == len(rows)
    for i, url, h in rows:
        raw, most = (h or "").encode(), largest[h or ""]
        x = got[i]
        assert (x["payload_bytes"], x["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (x["record_type"], x["refers_to"]) == (("response", None) if most == i else ("revisit", most))
        assert bytes(x["payload"]) == (raw if most == i else b"") and x["url"] == url


def test_archive_edge_rows(spark):
    schema = "page_id long, url string, html string"
    df = frame(spark, [(None, None, "a"), (4, None, "a"), (4, None, "a"), (2, None, "a")], schema).selectExpr("*", "1 AS digest", "2 AS page")
    got = sorted((str(x["page_id"]), x["record_type"], str(x["refers_to"])) for x in read_records(write_archives(df)).collect())
    assert got == [("2", "revisit", "4"), ("4", "response", "None"), ("4", "response", "None"), ("None", "response", "None")]
    assert read_records(write_archives(frame(spark, [], schema))).count() == 0


def archive(n=200):
    return [build_record(i, None, f"<html>{i} some text that repeats</html>".encode(), base64.b32encode(hashlib.sha1(f"<html>{i} some text that repeats</html>".encode()).digest()).decode(), None) for i in range(n)]


def test_dictionary_leads_the_archive():
    records = archive()
    content = build_archive(records)
    assert content[:4] == bytes.fromhex("5d2a4d18") and list(read_archive(content)) == records
    assert list(read_archive(build_archive(records[:3]))) == records[:3]


@pytest.mark.parametrize("harm", [lambda c: c[:-3], lambda c: c + b"junk!", lambda c: c[:-20] + b"\0" * 20])
def test_broken_archives_are_refused(harm):
    with pytest.raises(InvalidArchive):
        for record in read_archive(harm(build_archive(archive(40)))):
            parse_record(record)


@pytest.mark.parametrize("old, new", [(b"WARC/1.1", b"WARC/9"), (b"Content-Length: 1", b"Content-Length: 2"), (b"WARC-Date", b" WARC-Date"), (b"some text", b"some tex!"), (b"WARC-Type: response", b"X: y")])
def test_broken_records_are_refused(old, new):
    with pytest.raises(InvalidArchive):
        parse_record(archive(1)[0].replace(old, new, 1))


def test_kept_documents_keep_columns_that_measures_are_named_after(spark):
    from weft.llm.quality_rules import keep_good

    text = "the cat and the dog went to a house in the old town, where it was warm and they had all that a cat or a dog needs"
    df = frame(spark, [(1, text), (2, "a")], "doc_id long, text string").selectExpr("doc_id", "text", "111 AS n_words", "'a' AS kept", "5 AS `x.y`", "6 AS n_lines")
    out = keep_good(df)
    assert [tuple(r) for r in out.collect()] == [(1, text, 111, "a", 5, 6)] and out.columns == df.columns


def test_the_filter_of_kept_documents_stays_behind_the_measures(spark):
    from weft.llm.quality_rules import keep_good

    df = frame(spark, [(1, "a")], "doc_id long, text string")
    plan = keep_good(df)._jdf.queryExecution().optimizedPlan().toString()
    top = next(line for line in plan.splitlines() if "Filter" in line)
    assert "__weft_keep" in top and "split" not in top


def test_unknown_and_malformed_parts_have_defined_results(spark):
    rows = [(1, 0, "user", None, json.dumps([{"type": "video", "x": 1}, {"type": None}, 7, {"type": "image", "width": "wide"}])), (1, 1, "user", None, "{broken <|end|>"), (1, 2, "user", None, json.dumps({"type": "text", "text": "one"}))]
    a, b, c = (parse_turn(r["segment"])[1] for r in format_conversations(frame(spark, rows, TURNS), parts="parts").orderBy("seq").collect())
    assert a == [("text", '{"type": "video", "x": 1}{"type": null}7'), ("image", 0)]
    assert b == [("text", "{broken <|end|>")] and c == [("text", "one")]


def foreign(kind, block, extra=""):
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:6e1a>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\n{extra}Content-Length: {len(block)}"
    return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_from_elsewhere_and_broken_records_become_rows(spark):
    info = foreign("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields\r\n")
    page = foreign("response", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nhello", "Content-Type: application/http\r\nWARC-Target-URI: http://x/a\\b\r\n")
    bad = foreign("response", b"no header", "Content-Type: application/http\r\n")
    whole = build_archive([info, page, bad])
    rows = read_records(spark.createDataFrame([("a", whole), ("b", whole[:-4])], "path string, content binary")).collect()
    kinds = [(r["record_type"], r["payload_bytes"], r["error"] is None) for r in rows]
    assert kinds.count(("warcinfo", 13, True)) == 2 and kinds.count(("response", 5, True)) == 2 and sum(not ok for *_, ok in kinds) == 2
    own = next(r for r in rows if r["record_type"] == "response")
    assert own["page_id"] is None and own["record_uri"] == "<urn:uuid:6e1a>" and own["url"] == "http://x/a\\b" and bytes(own["payload"]) == b"hello"


def test_archives_are_saved_as_files_and_read_back(spark, tmp_path):
    from weft.llm.warc import save_archives

    df = frame(spark, [(i, f"http://x/{i}", f"<p>{i % 7}</p>") for i in range(60)], "page_id long, url string, html string").selectExpr("cast(page_id AS int) AS page_id", "url", "html")
    archives = write_archives(df)
    saved = save_archives(archives, f"file://{tmp_path}/out").collect()
    assert saved and all(r["path"].endswith(".warc.zst") for r in saved)
    files = spark.read.format("binaryFile").load(f"{tmp_path}/out/*.warc.zst").select("path", "content")
    want = sorted(tuple(r) for r in read_records(archives, kind="int").select("page_id", "record_type", "refers_to").collect())
    assert sorted(tuple(r) for r in read_records(files, kind="int").select("page_id", "record_type", "refers_to").collect()) == want
