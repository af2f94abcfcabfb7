"""Substring dedup by Relative Lempel-Ziv parsing against hash-sharded reference blocks.

The whole corpus is the reference. Its index is cut into blocks by anchors: the anchor of
a window of WINDOW words is the least hash of its ANCHOR-word sequences, so it follows
from the window's words alone, and equal windows have equal anchors wherever they stand.
A document is a sequence of windows; neighbours with one anchor form a segment, and each
segment is parsed in the block that owns its anchor, against every segment indexed there
that begins earlier. A block parses greedily: at each place the longest run of windows that also
begins earlier is the factor, from the earliest of equally long sources, and parsing goes
on behind it. Any factor spans at least WINDOW words, so every factor is long enough; as
the next one is sought at the next window, not behind the last word, windows across a
factor's boundary are checked too. A factor that ends with its segment may go on in the
next segment, in another block; factors come back to the document, where they are joined
at their boundaries into duplicate spans.

So every document meets every block in which an equal window could be, and no other, and
its text is moved once. Segments and factors travel packed, a row for each batch and
block; the number of blocks grows with the input. Of equal segments in a batch only the
earliest travels: a passage that a third of all documents share is sent once a batch.
A block over BLOCK_BYTES (a phrase within ever new words) is dealt out once more, by
windows in place of anchors, so that no task holds more.

Windows are equal if their 64-bit hashes and 32 bits of their anchors' hashes are; an
anchor with c windows meets c * c / 2**65 false matches on average. Words themselves are
not compared.

"Earlier" is a smaller id, or in one document an earlier start. Null text has no words.
Rows of a null id take no part: they are neither parsed nor indexed, and keep all words.
Rows that repeat an id and text are one document and get equal results; rows of one id
with different texts are documents of their own, between which the earlier start counts
(on equal starts the one with the smaller text tag). Empty tables give empty results.
Keys must be integers; other columns keep names and values, whatever the names are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import PACKED, buckets, ddl, exchange, integer_key, named, rows, split, unpack
from .textcore import U64, as_bytes, bucket_of, hash_bucket, hash_words, mix, ngrams, ranges, slices, spans, windows

WINDOW, ANCHOR = 20, 8
#: Most windows of a segment; most bytes of a block that is parsed in one task.
RUN, BLOCK_BYTES = 16, 128 << 20
TAG_BITS = 24
SEGMENTS, FACTORS, TEXTS = 0, 1, 2
_SEGMENT_TYPES = ("u4", "i8", "i8", "u1", "u8")
_FACTOR_TYPES = ("i8", "i8", "i4", "i8", "i8")
KEYS = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width consecutive elements, by doubling."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return x if size == width else np.minimum(x[: len(x) - (width - size)], x[width - size :])


def segments(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, anchor, first window, windows in it) of each segment, and the 64-bit symbols of all windows in order."""
    start, end, first = spans(raw, offsets)
    words = hash_words(raw, start, end, lower=False)
    at, row = windows(first, WINDOW)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none, np.zeros(0, np.uint64)
    anchor = _least(ngrams(words, ANCHOR), WINDOW - ANCHOR + 1)[at]
    symbol = ngrams(words, WINDOW)[at]
    begins = np.ones(len(at), bool)
    begins[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    where = np.flatnonzero(begins)
    # A recurring anchor makes longer ones, which are cut after RUN windows.
    own = np.diff(np.append(where, len(at)))
    parts = -(-own // RUN)
    where = np.repeat(where, parts) + RUN * ranges(np.zeros(len(parts), np.int64), parts)
    lengths = np.diff(np.append(where, len(at)))
    return row[where], anchor[where], at[where] - first[row[where]], lengths, symbol


def combine(anchor: np.ndarray, doc: np.ndarray, at: np.ndarray, lengths: np.ndarray, symbols: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """(segments, factors): of equal segments the earliest goes on; each other one is a factor of it at once."""
    begin = np.cumsum(lengths) - lengths
    mark = mix(symbols + ranges(np.zeros(len(lengths), np.int64), lengths).astype(np.uint64) * U64(0x9E3779B97F4A7C15))
    mark = mix((np.add.reduceat(mark, begin) if len(begin) else mark) ^ anchor) + lengths.astype(np.uint64)
    order = np.lexsort((at, doc, mark))
    head = np.append(True, mark[order][1:] != mark[order][:-1]) if len(order) else np.zeros(0, bool)
    leader = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    other = (doc[order] != doc[leader]) | (at[order] != at[leader])  # a repeated row is no copy of itself
    copies, sources = order[other], leader[other]
    stay = np.sort(order[head])
    kept = anchor[stay], doc[stay], at[stay], lengths[stay], symbols[ranges(begin[stay], lengths[stay])]
    return kept, (doc[copies], at[copies], lengths[copies], doc[sources], at[sources])


def _sent(found: tuple[np.ndarray, ...], n: int, by_symbol: bool) -> Iterator[pa.RecordBatch]:
    """Segments to their blocks and the factors found at once to their documents."""
    (anchor, doc, at, lengths, symbols), (d, a, count, source, source_at) = found
    if len(doc):
        # Half of the anchor's mixed hash travels: windows are told apart by 96 bits.
        own = anchor if by_symbol else anchor_block(anchor)
        yield from split(hash_bucket(symbols if by_symbol else own, n), SEGMENTS, (own.astype(np.uint32), doc, at), ((lengths, symbols),), "u1")
    if len(d):
        yield from split(bucket_of(d, n), FACTORS, (d, a, count.astype(np.int32), source, source_at))


def anchor_block(anchor: np.ndarray) -> np.ndarray:
    """Anchors are least hashes and crowd near zero; mixed once more they spread evenly."""
    return mix(anchor ^ U64(0x5851F42D4C957F2D))


def _index(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            raw, offsets = as_bytes(batch.column(2))
            found: list[tuple[np.ndarray, ...]] = []
            for lo, hi in slices(offsets):
                row, anchor, at, lengths, symbols = segments(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                found.append((anchor, ids[lo + row], at << TAG_BITS | tags[lo + row], lengths, symbols))
            if found:
                yield from _sent(combine(*(np.concatenate(c) for c in zip(*found, strict=True))), n, False)

    return run


def _classes(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of each element, first element of each class, size of each class)."""
    order = np.argsort(key, kind="stable")
    head = np.append(True, key[order][1:] != key[order][:-1]) if len(order) else np.zeros(0, bool)
    own = np.empty(len(order), np.int64)
    own[order] = np.cumsum(head) - 1
    return own, order[head], np.diff(np.append(np.flatnonzero(head), len(order)))


def longest(key: np.ndarray, inside: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, source) of the longest run at each place that also begins at a smaller place; the smallest of several such places.

    key: class of each window; inside: its place in its segment, of that many windows (lengths). Runs do not leave segments.
    """
    size, source = np.zeros(len(key), np.int64), np.full(len(key), -1)
    own, active = key, np.arange(len(key))
    for m in range(1, RUN + 1):
        if m > 1:
            active_on = inside[active] + m <= lengths[active]
            active, own = active[active_on], own[active_on]
            own = own * (int(key.max()) + 1) + key[active + m - 1] if len(active) else own
        if not len(active):
            break
        own, first, count = _classes(own)
        often = count[own] > 1
        source_of = active[first[own]]
        copied = often & (source_of != active)
        size[active[copied]], source[active[copied]] = m, source_of[copied]
        active, own = active[often], own[often]
    return size, source


def parse_block(anchor: np.ndarray, doc: np.ndarray, at: np.ndarray, lengths: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, ...]:
    """Factors of all segments of a block by greedy parsing: (doc, at, windows, source doc, source at), where at is start << TAG_BITS | tag."""
    none = np.zeros(0, np.int64)
    lengths = lengths.astype(np.int64)
    # Segments whose anchor stands alone repeat nothing, unless they repeat themselves.
    by = np.argsort(anchor, kind="stable")
    same = anchor[by][1:] == anchor[by][:-1]
    shared = np.zeros(len(by), bool)
    shared[1:] |= same
    shared[:-1] |= same
    keep = np.zeros(len(by), bool)
    keep[by[shared]] = True
    begin = np.cumsum(lengths) - lengths
    if len(symbols) > 1:
        keep |= _repeats_itself(symbols, lengths)
    chosen = np.flatnonzero(keep)
    if not len(chosen):
        return none, none, none, none, none
    chosen = chosen[np.lexsort((at[chosen], doc[chosen], anchor[chosen]))]
    # A repeated row is the same document.
    a, d, o = at[chosen], doc[chosen], anchor[chosen]
    chosen = chosen[np.append(True, (a[1:] != a[:-1]) | (d[1:] != d[:-1]) | (o[1:] != o[:-1]))]
    d, a, lengths = doc[chosen], at[chosen], lengths[chosen]
    place = ranges(begin[chosen], lengths)
    segment = np.repeat(np.arange(len(chosen)), lengths)
    inside = ranges(np.zeros(len(chosen), np.int64), lengths)
    # Equal windows agree in all bits of symbol and anchor. Places are in order of (anchor, doc, start).
    key, owner = symbols[place], anchor[chosen][segment]
    kind, first, _ = _classes(key)
    odd = owner != owner[first[kind]]
    if odd.any():  # one symbol under two anchors, a chance in 2**64
        kind[odd] = len(first) + np.unique(np.stack([key[odd], owner[odd]]), axis=1, return_inverse=True)[1].reshape(-1)
    size, source = longest(kind, inside, lengths[segment])
    copied = np.flatnonzero(size)
    if not len(copied):
        return none, none, none, none, none
    following = np.full(len(size) + 1, len(size))
    following[copied] = copied
    following = np.minimum.accumulate(following[::-1])[::-1]
    edges = np.append(np.cumsum(lengths) - lengths, len(size))
    now, stop = following[edges[:-1]], edges[1:]
    taken = []
    while True:
        on = now < stop
        now, stop = now[on], stop[on]
        if not len(now):
            break
        taken.append(now)
        now = following[now + size[now]]
    taken = np.sort(np.concatenate(taken))
    start = a[segment] + (inside << TAG_BITS)
    s = source[taken]
    return d[segment[taken]], start[taken], size[taken], d[segment[s]], start[s]


def _repeats_itself(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether any symbol stands twice in a segment."""
    segment = np.repeat(np.arange(len(lengths)), lengths)
    out = np.zeros(len(lengths), bool)
    for back in range(1, RUN):
        if len(symbols) <= back:
            break
        out[segment[back:][(symbols[back:] == symbols[:-back]) & (segment[back:] == segment[:-back])]] = True
    return out


def _parse(n: int, most: int | None):
    """Factors of each block. A block over that many bytes is dealt out anew, window by window, by their symbols."""

    def scattered(blob: bytes) -> Iterator[pa.RecordBatch]:
        anchor, doc, at, lengths, symbols = unpack(blob, _SEGMENT_TYPES)
        lengths = lengths.astype(np.int64)
        segment = np.repeat(np.arange(len(doc)), lengths)
        inside = ranges(np.zeros(len(lengths), np.int64), lengths)
        yield from _sent(combine(anchor.astype(np.uint64)[segment], doc[segment], at[segment] + (inside << TAG_BITS), np.ones(len(segment), np.int64), symbols), n, True)

    def parsed(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        if held:
            doc, at, count, source, source_at = parse_block(*(np.concatenate(c) for c in zip(*(unpack(b, _SEGMENT_TYPES) for b in held), strict=True)))
            if len(doc):
                yield from split(bucket_of(doc, n), FACTORS, (doc, at, count.astype(np.int32), source, source_at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, size = None, [], 0
        for batch in batches:
            for i, (bucket, kind) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                blob = batch.column(2)[i].as_py()
                if kind == FACTORS:
                    yield rows([(bucket, kind, blob)])
                    continue
                if bucket != current:
                    yield from parsed(held)
                    current, held, size = bucket, [], 0
                size += len(blob)
                held.append(blob)
                if most is not None and size > most:
                    for b in held:
                        yield from scattered(b)
                    held = []
        yield from parsed(held)

    return run


def _tagged(docs: DataFrame, key: str, text: str) -> DataFrame:
    integer_key(docs, key)
    return docs.select(named(key).cast("long").alias("id"), F.coalesce(named(text), F.lit("")).alias("text")).select("id", F.xxhash64("text").bitwiseAND(F.lit((1 << TAG_BITS) - 1)).alias("tag"), "text")


def packed_factors(docs: DataFrame, n: int, key: str, text: str) -> DataFrame:
    indexed = _tagged(docs, key, text).where("id IS NOT NULL").mapInArrow(_index(n), PACKED)
    parsed = exchange(indexed, n).mapInArrow(_parse(n, BLOCK_BYTES), PACKED)
    return exchange(parsed, n).mapInArrow(_parse(n, None), PACKED)


def factors(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, n_words, source_doc_id, source_start): each factor, in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(2):
                doc, at, count, source, source_at = unpack(blob.as_py(), _FACTOR_TYPES)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, at >> TAG_BITS, count.astype(np.int64) + WINDOW - 1, source, source_at >> TAG_BITS)], ["doc_id", "start", "n_words", "source_doc_id", "source_start"])

    return packed_factors(docs, buckets(docs), key, text).mapInArrow(run, "doc_id bigint, start bigint, n_words bigint, source_doc_id bigint, source_start bigint")


def _joined(docs: DataFrame, key: str, text: str, more: list[str], answer, schema: str) -> DataFrame:
    """Each document with its factors: both go to the bucket of the id; within it the factors come first."""
    n = buckets(docs)
    found = packed_factors(docs, n, key, text).selectExpr("bucket", "kind", "blob", "null AS row")
    # Other columns go by number, so that none can clash with ours.
    texts = docs.select(*(named(c).alias(f"__weft_own{i}") for i, c in enumerate(more)), named(key).alias("__weft_id"), named(text).alias("__weft_text")).select(
        F.pmod(F.xxhash64(F.coalesce(F.col("__weft_id").cast("long"), F.lit(0))), F.lit(n)).cast("int").alias("bucket"),
        F.lit(TEXTS).alias("kind"),
        F.lit(None).cast("binary").alias("blob"),
        F.struct(F.col("__weft_id").cast("long").alias("__weft_id"), F.xxhash64(F.coalesce("__weft_text", F.lit(""))).bitwiseAND(F.lit((1 << TAG_BITS) - 1)).alias("__weft_tag"), F.col("__weft_text"), *(f"__weft_own{i}" for i in range(len(more)))).alias("row"),
    )
    both = texts.unionByName(found.withColumn("row", F.col("row").cast(texts.schema["row"].dataType)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blobs, table = None, [], None
        for batch in batches:
            own, kinds, held, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2), batch.column(3)
            edges = np.flatnonzero(np.diff(own, prepend=own[0] - 1))
            for lo, hi in zip(edges, np.append(edges[1:], len(own)), strict=True):
                if own[lo] != bucket:
                    bucket, blobs, table = own[lo], [], None
                factor_rows = np.flatnonzero(kinds[lo:hi] == FACTORS) + lo
                blobs += [unpack(held[int(i)].as_py(), _FACTOR_TYPES)[:3] for i in factor_rows]
                text_rows = np.flatnonzero(kinds[lo:hi] == TEXTS) + lo
                if not len(text_rows):
                    continue
                if table is None:
                    table = _table(blobs)
                    blobs = []
                some = rows.slice(int(text_rows[0]), len(text_rows))
                fields = {f.name: some.field(i) for i, f in enumerate(some.type)}
                offsets = as_bytes(fields["__weft_text"])[1]
                for a, b in slices(offsets):
                    yield answer({k: v.slice(a, b - a) for k, v in fields.items()}, table)

    return exchange(both, n).mapInArrow(run, schema)


def _table(blobs: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
    """Factors ordered by document, tag and start."""
    if not blobs:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    doc, at, count = (np.concatenate(c).astype(np.int64) for c in zip(*blobs, strict=True))
    tag = at & ((1 << TAG_BITS) - 1)
    order = np.lexsort((at, tag, doc))
    return doc[order], tag[order], (at >> TAG_BITS)[order], count[order]


def removed_words(table: tuple[np.ndarray, ...], doc: int | None, tag: int, n_words: int) -> np.ndarray | None:
    """Which words of a document its factors cover, joined at their boundaries; None if none are."""
    if doc is None or not len(table[0]):
        return None
    lo, hi = np.searchsorted(table[0], (doc, doc + 1) if doc < 2**63 - 1 else doc, "left") if doc < 2**63 - 1 else (np.searchsorted(table[0], doc), len(table[0]))
    if lo == hi:
        return None
    a, b = lo + np.searchsorted(table[1][lo:hi], tag, "left"), lo + np.searchsorted(table[1][lo:hi], tag, "right")
    if a == b:
        return None
    depth = np.zeros(n_words + 1, np.int32)
    np.add.at(depth, table[2][a:b], 1)
    np.add.at(depth, np.minimum(table[2][a:b] + table[3][a:b] + WINDOW - 1, n_words), -1)
    return np.cumsum(depth)[:n_words] > 0


def digest_kept(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): kept words joined by one space."""
    kind = integer_key(docs, key)
    schema = f"`{key}` {kind}, n_words bigint, n_removed bigint, kept_sha256 string"

    def answer(fields: dict[str, pa.Array], table: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        n_words, n_removed, digest = [], [], []
        raw, offsets = as_bytes(fields["__weft_text"])
        whole = raw.tobytes()
        for r, (doc, tag) in enumerate(zip(fields["__weft_id"].to_pylist(), fields["__weft_tag"].to_pylist(), strict=True)):
            words = whole[offsets[r] : offsets[r + 1]].split()
            gone = removed_words(table, doc, tag, len(words))
            kept = words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
            digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.RecordBatch.from_arrays([fields["__weft_id"].cast(KEYS[kind]), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest)], [key, "n_words", "n_removed", "kept_sha256"])

    return _joined(docs, key, text, [], answer, schema)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", drop_emptied: bool = False) -> DataFrame:
    """The documents with all columns, without their repeated words.

    A text that loses nothing is left as it is; of others, each run of removed words goes with the white space behind it.
    drop_emptied: documents that lose all their words go; without it their text becomes empty.
    """
    more = [c for c in docs.columns if c not in (key, text)]
    kind = integer_key(docs, key)
    schema = ddl(docs.schema)

    def answer(fields: dict[str, pa.Array], table: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        out, emptied = [], []
        raw, offsets = as_bytes(fields["__weft_text"])
        start, end, first = spans(raw, offsets)
        nulls = fields["__weft_text"].is_null().to_pylist()
        for r, (doc, tag) in enumerate(zip(fields["__weft_id"].to_pylist(), fields["__weft_tag"].to_pylist(), strict=True)):
            lo, hi = int(first[r]), int(first[r + 1])
            gone = removed_words(table, doc, tag, hi - lo)
            own = raw[offsets[r] : offsets[r + 1]]
            if gone is not None:
                keep = np.ones(len(own), bool)
                edge = np.diff(gone.astype(np.int8), prepend=0, append=0)
                for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                    to = int(start[lo + b]) if lo + b < hi else int(offsets[r + 1])
                    keep[int(start[lo + a] - offsets[r]) : to - int(offsets[r])] = False
                own = own[keep]
            emptied.append(gone is not None and bool(gone.all()))
            out.append(None if nulls[r] else own.tobytes().decode())
        columns = {c: fields[f"__weft_own{i}"] for i, c in enumerate(more)}
        columns |= {key: fields["__weft_id"].cast(KEYS[kind]), text: pa.array(out, pa.string())}
        batch = pa.RecordBatch.from_arrays([columns[c] for c in docs_columns], docs_columns)
        return batch.filter(pa.array([not e for e in emptied])) if drop_emptied else batch

    docs_columns = list(docs.columns)
    return _joined(docs, key, text, more, answer, schema)
