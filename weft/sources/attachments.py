"""Attachment readers: bounded text previews, delimited text and workbooks, over rows of (path, content)."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_FILE, MOST_TEXT, MOST_LINES, MOST_CHARS, MOST_MEMBER = 16 << 20, 64 << 10, 40, 8000, 8 << 20
SENSITIVE = re.compile(r"password|passwd|secret|token|api.?key|email|phone|login", re.I)
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of all files; the content of one over the size bound is null and not read."""
    files = spark.read.format("binaryFile").load(path)
    large = files.where(F.col("length") > MOST_FILE).select("path", "length", F.lit(None).cast("binary").alias("content"))
    return files.where(F.col("length") <= MOST_FILE).select("path", "length", "content").unionByName(large)


def text_preview(files: DataFrame) -> DataFrame:
    """(path, status, preview): the first lines of text; binary and invalid text is named, not shown. All in the JVM."""
    head = F.substring("content", 1, MOST_TEXT)
    text = F.try_validate_utf8(head.cast("string"))
    status = F.when(F.col("content").isNull(), "too_large").when(F.length("content") == 0, "empty").when(F.instr(head.cast("string"), "\0") > 0, "binary").when(text.isNull(), "invalid_utf8").otherwise("text")
    shown = F.left(F.array_join(F.slice(F.split(text, "\r\n|\n|\r"), 1, MOST_LINES), "\n"), F.lit(MOST_CHARS))
    return files.select("path", status.alias("status"), F.when(status == "text", shown).alias("preview"))


def parse_delimited(text: str, delimiter: str = ",") -> tuple[list[list[str]], bool]:
    """(records, complete): quoted fields may hold delimiters, breaks and doubled quotes; an open quote at the end makes it incomplete."""
    complete = text.count('"') % 2 == 0
    rows = list(csv.reader(io.StringIO(text if complete else text + '"', newline=""), delimiter=delimiter))
    return [r for r in rows if r], complete


def redact_table(rows: list[list[str]]) -> list[list[str]]:
    """Columns with a sensitive header are blanked; e-mail addresses and phone numbers go everywhere."""
    if not rows:
        return rows
    hidden = {i for i, h in enumerate(rows[0]) if SENSITIVE.search(h)}
    clean = lambda x: re.sub(r"\+?\d[\d ()-]{8,}\d", "[PHONE]", re.sub(r"[\w.+-]+@[\w-]+\.[\w.-]+", "[EMAIL]", x))
    return [rows[0]] + [["[REDACTED]" if i in hidden else clean(x) for i, x in enumerate(r)] for r in rows[1:]]


def column_index(name: str) -> int:
    """A is 0, Z 25, AA 26."""
    n = 0
    for c in name:
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def workbook_rows(content: bytes, most_rows: int = 20) -> list[list[str]]:
    """The first rows of the first sheet. Members over the size bound are refused."""

    def member(z: zipfile.ZipFile, name: str) -> bytes:
        if z.getinfo(name).file_size > MOST_MEMBER:
            raise ValueError("a workbook member is too large")
        return z.read(name)

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(member(z, "xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        sheets = sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        if not sheets:
            raise ValueError("no sheet")
        out = []
        for row in ElementTree.fromstring(member(z, sheets[0])).iter(f"{_MAIN}row"):
            cells: list[str] = []
            for c in row.iter(f"{_MAIN}c"):
                at = column_index(re.sub(r"\d", "", c.get("r") or "A"))
                value, kind = c.findtext(f"{_MAIN}v") or "", c.get("t")
                if kind == "s":
                    value = shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                cells += [""] * (at + 1 - len(cells))
                cells[at] = value
            out.append(cells)
            if len(out) == most_rows:
                break
        return out


def workbook_preview(files: DataFrame, most_rows: int = 20) -> DataFrame:
    """(path, status, rows): redacted rows as JSON; unreadable workbooks are named."""
    import json

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            status, rows = [], []
            for content in batch.column(1):
                if not content.is_valid:
                    rows.append(None)
                    status.append("too_large")
                    continue
                try:
                    rows.append(json.dumps(redact_table(workbook_rows(content.as_py(), most_rows)), ensure_ascii=False))
                    status.append("table")
                except (ValueError, zipfile.BadZipFile, ElementTree.ParseError, KeyError) as e:
                    rows.append(None)
                    status.append(f"unreadable: {type(e).__name__}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(status), pa.array(rows, pa.string())], ["path", "status", "rows"])

    return files.select("path", "content").mapInArrow(run, "path string, status string, rows string")
