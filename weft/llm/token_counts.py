"""Token counts by section: whole documents are encoded once, and token spans are joined with section spans.

A token's span is its bytes within the text. Sections are the lines of a text (each with
its line break), or what a column of ascending byte offsets ends (sections): offsets past
the text or out of order are taken as the largest so far, and a last section holds what is
left behind the last offset. A token that crosses a border goes, whole, to the
section that holds its first byte: counts are integers and add up to the document's.
Crossing tokens are counted beside it, in the section they begin in.

Null or empty text has one empty section with no tokens. Rows are handled one by one;
repeated rows and ids give repeated results; an empty table gives an empty result. Very
long texts are encoded in whole, never in prefixes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .exchange import named
from .textcore import as_bytes

class RankEncoder:
    """Byte-pair encoding by a file of ranks, with the byte length of each id."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """Byte offsets at which the tokens of the whole text end."""
        return np.cumsum(self.lengths[np.array(self.encoding.encode_ordinary(text), np.int64)])


_made: dict[tuple[str, str], RankEncoder] = {}


def encoder(path: str, pattern: str) -> RankEncoder:
    if (path, pattern) not in _made:
        _made[path, pattern] = RankEncoder(path, pattern)
    return _made[path, pattern]


def attribute(token_ends: np.ndarray, section_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section; both arguments are ascending byte offsets that end together."""
    starts = token_ends - np.diff(token_ends, prepend=0)
    section = np.searchsorted(section_ends, starts, "right")
    last = np.searchsorted(section_ends, token_ends - 1, "right")
    n = len(section_ends)
    return np.bincount(section, minlength=n)[:n], np.bincount(section[last > section], minlength=n)[:n]


def line_ends(raw: np.ndarray) -> np.ndarray:
    """Byte offsets after each line break, and the end of the text."""
    cuts = np.flatnonzero(raw == 10) + 1
    return cuts if len(cuts) and cuts[-1] == len(raw) else np.append(cuts, len(raw))


def given_ends(offsets: list[int | None] | None, n: int) -> np.ndarray:
    """Section ends of a text of n bytes from an array of offsets (null: one section)."""
    ends = np.array([min(max(x or 0, 0), n) for x in offsets or []], np.int64)
    ends = np.maximum.accumulate(ends) if len(ends) else ends
    return ends if len(ends) and ends[-1] == n else np.append(ends, n)


def token_counts(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", sections: str | None = None) -> DataFrame:
    """One row for each section: key, section (from 0), start_byte, n_bytes, n_tokens, n_crossing, doc_tokens.

    sections: a column of arrays of byte offsets at which a document's sections end; without it lines are the sections.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "section", "start_byte", "n_bytes", "n_tokens", "n_crossing", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                raw, offsets = as_bytes(part.column(1))
                columns: list[list[np.ndarray]] = [[] for _ in names]
                for r in range(part.num_rows):
                    own = raw[offsets[r] : offsets[r + 1]]
                    ends = line_ends(own) if sections is None else given_ends(part.column(2)[r].as_py(), len(own))
                    tokens = enc.ends(own.tobytes().decode()) if len(own) else np.zeros(0, np.int64)
                    counts, crossing = attribute(tokens, ends)
                    starts = np.append(0, ends[:-1])
                    for c, v in zip(columns, (np.full(len(ends), r), np.arange(len(ends)), starts, ends - starts, counts, crossing, np.full(len(ends), len(tokens))), strict=True):
                        c.append(v)
                flat = [np.concatenate(c) for c in columns]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(flat[0])), pa.array(flat[1].astype(np.int32)), *(pa.array(c.astype(np.int64)) for c in flat[2:])], names)

    return docs.select(named(key), named(text), *([] if sections is None else [named(sections).cast("array<bigint>").alias("sections")])).mapInArrow(run, f"`{key}` {kind}, section int, start_byte bigint, n_bytes bigint, n_tokens bigint, n_crossing bigint, doc_tokens bigint")
