"""Chat formatting with typed content parts.

A visitor flattens a turn's parts into text: text parts are escaped; image, audio and
document parts become ordered placeholders, and their references and expanded token
counts are recorded. A turn is written as

    <|turn|>ROLE<|body|>CONTENT<|end|>

Inside roles and contents "&" is written as "&amp;" and "<" as "&lt;", so that no text
holds a control string and unescaping gives back each character. The loss mask covers the content of assistant
turns. Output rows are turns with their place in the conversation's output, so that one
conversation of any length never stands in memory as a whole.

Order within a conversation: turn, then role, then text; nulls first. Null role or text
counts as empty; rows of a null conv_id form a conversation of their own. Repeated rows
are turns of their own. An empty table gives an empty result. Parts of unknown types are
kept as the text of their JSON, and parts that are no JSON as a text. A conversation is
formatted in one task, as each turn's place follows from those before it, but streams
through it turn by turn; one that holds a third of all turns takes a third of the time.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import named

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: Tokens that a placeholder stands for: a fixed number, or one for each unit of its size (rounded up).
IMAGE_TILE_PIXELS, IMAGE_TILE_TOKENS, AUDIO_TOKENS_A_SECOND, DOCUMENT_TOKENS_A_PAGE = 512, 256, 25, 600


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;")


def unescape(text: str) -> str:
    return text.replace("&lt;", "<").replace("&amp;", "&")


@dataclass
class Flat:
    """A turn's content and what its placeholders stand for."""

    content: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)


def _size(part: dict, name: str) -> int:
    """A size rounded up; what is missing, no finite number, or under 1 counts as 1."""
    value = part.get(name)
    return max(1, math.ceil(value)) if isinstance(value, int | float) and not isinstance(value, bool) and math.isfinite(value) else 1


def parts_of(parts: str | None, text: str) -> list:
    """The parts of a turn: a JSON list; other JSON is one part, and what is no JSON at all is a text."""
    if parts is None:
        return [{"type": "text", "text": text}]
    try:
        found = json.loads(parts)
    except ValueError:
        return [{"type": "text", "text": parts}]
    return found if isinstance(found, list) else [found]


class PartVisitor:
    """One method for each type of part; placeholders are numbered in order through the conversation."""

    def __init__(self):
        self.number = 0

    def visit(self, part: dict, out: Flat) -> None:
        kind = part.get("type", "text") if isinstance(part, dict) else None
        method = {"text": self.visit_text, "image": self.visit_image, "audio": self.visit_audio, "document": self.visit_document}.get(kind) if isinstance(kind, str) else None
        (method or self.visit_unknown)(part, out)

    def visit_text(self, part: dict, out: Flat) -> None:
        text = part.get("text")
        out.content.append(escape(text if isinstance(text, str) else "" if text is None else json.dumps(text, ensure_ascii=False)))

    def visit_unknown(self, part: object, out: Flat) -> None:
        """What is no known part is kept as the text of its JSON."""
        out.content.append(escape(json.dumps(part, ensure_ascii=False)))

    def visit_image(self, part: dict, out: Flat) -> None:
        tiles = -(-_size(part, "width") // IMAGE_TILE_PIXELS) * -(-_size(part, "height") // IMAGE_TILE_PIXELS)
        self._attach("image", part, tiles * IMAGE_TILE_TOKENS, out)

    def visit_audio(self, part: dict, out: Flat) -> None:
        self._attach("audio", part, _size(part, "seconds") * AUDIO_TOKENS_A_SECOND, out)

    def visit_document(self, part: dict, out: Flat) -> None:
        self._attach("document", part, _size(part, "pages") * DOCUMENT_TOKENS_A_PAGE, out)

    def _attach(self, kind: str, part: dict, tokens: int, out: Flat) -> None:
        out.content.append(f"<|{kind}:{self.number}|>")
        out.attachments.append({"number": self.number, "type": kind, "ref": part.get("ref"), "tokens": tokens})
        self.number += 1


_CONTROL = re.compile(r"<\|(turn|body|end)\|>|<\|(image|audio|document):(\d+)\|>")


def parse_turn(segment: str) -> tuple[str, list[tuple[str, str | int]]]:
    """(role, [("text", its text) or (kind, number), ...]) of one formatted turn; raises ValueError on any other string."""
    marks = list(_CONTROL.finditer(segment))
    if len(marks) < 3 or marks[0][0] != TURN or marks[1][0] != BODY or marks[-1][0] != END or marks[0].start() or marks[-1].end() != len(segment):
        raise ValueError("not a formatted turn")
    role = unescape(segment[marks[0].end() : marks[1].start()])
    parts: list[tuple[str, str | int]] = []
    at = marks[1].end()
    for m in marks[2:]:
        if m.start() > at:
            parts.append(("text", unescape(segment[at : m.start()])))
        at = m.end()
        if m[2]:
            parts.append((m[2], int(m[3])))
        elif m[1] != "end" or m is not marks[-1]:
            raise ValueError("a control string inside a turn")
    return role, parts


FORMATTED = "seq bigint, segment string, start bigint, loss_start bigint, loss_chars bigint, attachments string, expanded_tokens bigint"


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: str | None = None) -> DataFrame:
    """(conv, seq, segment, start, loss_start, loss_chars, attachments, expanded_tokens): a conversation's output is its segments in order of seq.

    start and loss_start are code points from the conversation's beginning; loss_chars is 0 for turns without loss.
    parts names a column with a JSON list of typed parts to be used where it is not null; attachments is JSON.
    """
    kind = turns.schema[conv].dataType.simpleString()
    body: Column = named(parts) if parts else F.lit(None).cast("string")
    rows = turns.select(named(conv), named(turn).alias("turn"), F.coalesce(named(role), F.lit("")).alias("role"), F.coalesce(named(text), F.lit("")).alias("text"), body.alias("parts"))
    dealt = rows.repartition(named(conv)).sortWithinPartitions(named(conv), "turn", "role", "text", "parts")
    return dealt.mapInArrow(_format, f"`{conv}` {kind}, {FORMATTED}")


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, seq, at, visitor = object(), 0, 0, PartVisitor()
    for batch in batches:
        columns: list[list] = [[] for _ in range(7)]
        for c, role, text, parts in zip(batch.column(0).to_pylist(), *(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
            if c != conv:
                conv, seq, at, visitor = c, 0, 0, PartVisitor()
            flat = Flat()
            for part in parts_of(parts, text):
                visitor.visit(part, flat)
            content = "".join(flat.content)
            head = f"{TURN}{escape(role)}{BODY}"
            segment = f"{head}{content}{END}"
            loss = len(content) if role == "assistant" else 0
            for col, v in zip(columns, (seq, segment, at, at + len(head), loss, json.dumps(flat.attachments), sum(a["tokens"] for a in flat.attachments)), strict=True):
                col.append(v)
            seq += 1
            at += len(segment)
        names = [batch.schema.names[0], "seq", "segment", "start", "loss_start", "loss_chars", "attachments", "expanded_tokens"]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True))], names)


READ = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(formatted: DataFrame, conv: str = "conv_id", ordered: bool = False) -> DataFrame:
    """Digests of each conversation, parsed from its segments alone. Placeholders count as no text.

    ordered: the rows come straight from format_conversations(), whose tasks hold whole conversations in order.
    """
    kind = formatted.schema[conv].dataType.simpleString()
    rows = formatted.select(named(conv), "seq", "segment", "start", "loss_start", "loss_chars")
    if not ordered:
        rows = rows.repartition(named(conv)).sortWithinPartitions(named(conv), "seq")
    return rows.mapInArrow(_read, f"`{conv}` {kind}, {READ}")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names: list[str] = []
    kind = None
    state: list | None = None

    def finish(s: list) -> tuple:
        return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]

    def batch_of(done: list[tuple]) -> pa.RecordBatch:
        c = list(zip(*done, strict=True)) if done else [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c[0], kind), *(pa.array(v, t) for v, t in zip(c[1:], (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True))], [names[0], *(x.split()[0] for x in READ.split(", "))])

    for batch in batches:
        names, kind = batch.schema.names, batch.column(0).type
        done = []
        for c, segment, start, loss_start, loss in zip(batch.column(0).to_pylist(), *(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
            if state is None or state[0] != c:
                if state is not None:
                    done.append(finish(state))
                state = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, parts = parse_turn(segment)
            text = "".join(p[1] for p in parts if p[0] == "text")
            state[1] += 1
            state[2].update(f"{role}\n{text}\n".encode())
            if loss:
                masked = segment[loss_start - start : loss_start - start + loss]
                masked = unescape(_CONTROL.sub("", masked))
                state[3] += len(masked)
                state[4].update(masked.encode())
            state[5] += len(segment)
        yield batch_of(done)
    if state is not None:
        yield batch_of([finish(state)])
