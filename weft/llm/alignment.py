"""Alignment of two tokenizers' tokens, in Spark's own relational operations.

align() takes, for each text, the ids and byte lengths of two token sequences over the same
bytes. Tokens are exploded with their positions; windowed sums of lengths give their ends; a full
equi-join on text and end puts a row at every byte where a token of either side ends. Where both
do, there is a cut; running counts of cuts number the groups. Each row also stands for one link:
the bytes up to its end, back to the row before, belong to one token of each side, the first
that ends there or later. So links come from a window over the joined ends, as many as there
are ends, and never from pairing the tokens of a group with each other.

Whole corpora repeat their words. A text falls into pieces that neither tokenizer looks
across (see text_pieces), so align_documents() aligns each distinct piece once, with the
number of times it stands in texts, and puts documents together from pieces. Counts of links,
best links and groups are those of all occurrences. Texts are taken in slices and pieces in
buckets; between them travel packed rows, one for each slice and bucket, in which nothing
but the order of its pieces says what belongs to which.

A tokenizer pair is (a: byte-level BPE file of the tokenizers library, which sees space + text;
b: merge-type SentencePiece model with byte fallback, which adds the space itself). Strings of
special tokens are plain text.

Null and empty texts, and those that b's normalizer would change or that hold its word
mark, have no tokens: zeros and an empty string. Rows are handled one by one whatever their key, so
repeated ids and rows give rows of their own; null keys stay null; an empty table gives an
empty result. Columns are read by name and others ignored. Very long texts are cut at pieces only; a
text without such a place is one piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .exchange import buckets, cut, named, opened, squeezed
from .memory import give_back, trim
from .textcore import as_bytes, hash_bucket, hash_words, ranges, slices

MARK = "▁"
#: Bytes of text whose pieces are told apart and answered together; a longer text stands alone.
SLICE = 12 << 20
#: Occurrences of pieces whose sums are taken at once.
PIECES = 1 << 18
#: Bytes of text whose pieces are found at once.
STRETCH = 1 << 20
#: Pieces in one call of a tokenizer, and id pairs (of 24 bytes) that may be broadcast.
CALL, BROADCAST_PAIRS = 2000, 1_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: First bytes of characters that are certainly no white space of Unicode: ASCII that shows, and all but those that begin U+0080-00BF and U+1000-3FFF.
_SHOWS = np.zeros(256, bool)
_SHOWS[33:127] = True
_SHOWS[[*range(0xC3, 0xE1), *range(0xE4, 0xF8)]] = True


def text_pieces(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, number in each row) of all pieces of non-empty texts; a piece goes without the space before it.

    A text, with a space put before it, is cut before each space that follows a character other
    than white space and precedes one. The pattern of byte-level BPE begins a new word at such a space
    and nowhere looks beyond a character that is not white space; merge-type pieces hold no word mark behind
    another character. So neither joins or decides anything across a cut.
    """
    n = len(raw)
    inner = raw == 32
    inner[:1] = False
    inner[1:] &= ~_SPACE[raw[:-1]]
    inner[:-1] &= _SHOWS[raw[1:]]
    inner[-1:] = False
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    inner[edges] = False  # a text's first space has only the added one before it
    inner[edges - 1] = False
    cuts = np.flatnonzero(inner)
    filled = np.diff(offsets) > 0
    start = np.sort(np.concatenate([offsets[:-1][filled], cuts + 1]))
    end = np.sort(np.concatenate([offsets[1:][filled], cuts]))
    return start, end, np.diff(np.searchsorted(start, offsets))


class TokenizerPair:
    """Ids and bytes of both tokenizers for pieces."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        # The byte alphabet has a character for each byte; characters whose bytes are known show it. Bytes that no text has stand for themselves.
        alphabet = ByteLevel(add_prefix_space=False, use_regex=False)
        of_byte = {chr(b): b for b in (0xC0, 0xC1, *range(0xF5, 0x100))}
        for point in (*range(0x80), *range(0x80, 0x800), 0x800, 0x1000, *range(0x1000, 0x10000, 0x1000), *range(0x10000, 0x110000, 0x10000)):
            if not 0xD800 <= point < 0xE000:
                shown = "".join(s for s, _ in alphabet.pre_tokenize_str(chr(point)))
                of_byte |= dict(zip(shown, chr(point).encode(), strict=True))
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(of_byte[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.b.id_to_piece(i) for i in range(self.b.get_piece_size()))]
        if any(MARK in p.lstrip(MARK) for p in (self.b.id_to_piece(i) for i in range(len(self.b_bytes)))):
            raise ValueError("pieces with a word mark behind another character are not supported")
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int32) for t in (self.a_bytes, self.b_bytes))
        if max(self.a_sizes.max(), self.b_sizes.max()) >= SIZES or max(len(self.a_sizes), len(self.b_sizes)) >= (1 << 31) // SIZES:
            raise ValueError("ids or tokens are too large to travel as one integer")

    def encode(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [e.ids for e in self.a.encode_batch_fast([" " + p for p in pieces], add_special_tokens=False)]
        b = self.b.encode(pieces, num_threads=1)
        for piece, x, y in zip(pieces, a, b, strict=True):
            want = b" " + piece.encode()
            if b"".join([self.a_bytes[i] for i in x]) != want or b"".join([self.b_bytes[i] for i in y]) != want:
                raise ValueError(f"the tokens do not spell {piece[:40]!r}: not a lossless pair of tokenizers")
        return a, b


def lossless(b, text: str) -> bool:
    """Whether pieces of b, a SentencePiece processor, spell space + text: its normalizer changes nothing, and every space is one."""
    return MARK not in text and b.normalize(text) == MARK + text.replace(" ", MARK)


#: A token travels as id * SIZES + length in bytes.
TOKENS, SIZES = "a array<int>, b array<int>", 1024


def _lists(ids: list[list[int]], sizes: np.ndarray) -> pa.Array:
    flat = np.fromiter((i for x in ids for i in x), np.int32)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)), pa.array(flat * SIZES + sizes[flat]))


def encode_pieces(pieces: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(id, n, TOKENS) of (id, n, piece): both token sequences of each piece, which follows a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        both = TokenizerPair(a_path, b_path)
        for batch in batches:
            for at in range(0, batch.num_rows, CALL):
                part = batch.slice(at, CALL)
                a, b = both.encode(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _lists(a, both.a_sizes), _lists(b, both.b_sizes)], ["id", "n", "a", "b"])
        # Loaded for the task alone: the worker goes on to other stages.
        del both
        trim()

    return pieces.select("id", "n", "piece").mapInArrow(run, f"id bigint, n bigint, {TOKENS}")


def _ends(tokens: DataFrame) -> DataFrame:
    """(id, n, second, end, token): tokens of both sides with the byte where each ends; second: of side b."""
    each = tokens.select("id", "n", F.size("a").alias("n_a"), F.posexplode(F.concat("a", "b")).alias("pos", "t"))
    each = each.select("id", "n", (F.col("pos") >= F.col("n_a")).alias("second"), "pos", F.floor(F.col("t") / SIZES).cast("int").alias("token"), (F.col("t") % SIZES).alias("size"))
    before = Window.partitionBy("id", "second").orderBy("pos")
    return each.select("id", "n", "second", F.sum("size").over(before).cast("int").alias("end"), "token")


def align(tokens: DataFrame) -> DataFrame:
    """(id, n, end, a, b, a_token, b_token, grp): a row at every byte where a token ends.

    a and b are the tokens that end there (null: none of that side), a_token and b_token those that
    the bytes before it belong to, which is one link; grp counts groups from 0. Takes (id, n, TOKENS),
    where id is unique and n is carried along.
    """
    # The id alone deals out, once: explode, windows, join and groups of an id stay in one task. Both sides meet on
    # (id, end) by grouping, which is their full equi-join: an end has at most one token of each side.
    of = lambda second: F.max(F.when(F.col("second") == second, F.col("token")))
    joined = _ends(tokens.repartition("id")).groupBy("id", "n", "end").agg(of(False).alias("a"), of(True).alias("b"))
    # Read from the end, the last token seen is the first that ends here or later.
    back = Window.partitionBy("id").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = lambda c: F.last(c, ignorenulls=True).over(back)
    cuts = F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1))
    return joined.select("id", "n", "end", "a", "b", filled("a").alias("a_token"), filled("b").alias("b_token"), (cuts.over(Window.partitionBy("id")) - cuts.over(back)).cast("int").alias("grp"))


def gathered(aligned: DataFrame) -> DataFrame:
    """(id, n, n_a, n_b, n_groups, n_links, groups, links): each text's alignment, its groups as `a1,a2|b1;a3|b2`, its links as an array of (a, b)."""
    joined = lambda c: F.array_join(F.transform(F.filter("ends", lambda x: x[c].isNotNull()), lambda x: x[c].cast("string")), ",")
    each = aligned.groupBy("id", "grp").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("end", "a", "b", "a_token", "b_token"))).alias("ends"))
    held = lambda c: F.size(F.filter("ends", lambda x: x[c].isNotNull()))
    links = F.transform("ends", lambda x: F.struct(x["a_token"].alias("a"), x["b_token"].alias("b")))
    each = each.select("id", "n", held("a").alias("n_a"), held("b").alias("n_b"), F.struct("grp", F.concat(joined("a"), F.lit("|"), joined("b")).alias("s"), links.alias("links")).alias("own"))
    out = each.groupBy("id").agg(F.max("n").alias("n"), F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.sort_array(F.collect_list("own")).alias("own"))
    links = F.flatten(F.transform("own", lambda x: x["links"]))
    return out.select("id", "n", "n_a", "n_b", F.size("own").cast("bigint").alias("n_groups"), F.size(links).cast("bigint").alias("n_links"), F.array_join(F.transform("own", lambda x: x["s"]), ";").alias("groups"), links.alias("links"))


def pair_counts(texts: DataFrame) -> DataFrame:
    """(a, b, count, is_best): links of each id pair over all n copies of the texts of gathered(); best: no other pair of its b id has more."""
    counts = texts.select("n", F.explode("links").alias("l")).groupBy("l.a", "l.b").agg(F.sum("n").alias("count"))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("is_best"))


def link_sums(texts: DataFrame) -> DataFrame:
    """(id, n_best, count_sum) of each text's links."""
    pairs = cut(pair_counts(texts), "pairs")
    if pairs.count() <= BROADCAST_PAIRS:  # otherwise links and pairs are joined by a shuffle
        pairs = F.broadcast(pairs)
    each = texts.select("id", F.explode("links").alias("l")).select("id", "l.a", "l.b").join(pairs, ["a", "b"])
    return each.groupBy("id").agg(F.count_if("is_best").alias("n_best"), F.sum("count").alias("count_sum"))


SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def shortened(numbers: np.ndarray) -> bytes:
    """Numbers of up to four bytes each; small ones take less."""
    return squeezed([numbers.astype(np.uint32)])


def lengthened(blob: bytes, n: int) -> np.ndarray:
    (out,) = opened(blob, ["u4"])
    if len(out) != n:
        raise ValueError(f"{len(out)} numbers, not {n}")
    return out


def hashed_pieces(raw: np.ndarray, offsets: np.ndarray, fine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, number in each row, hash) of the pieces of the texts that are fine, found some texts at a time."""
    counts, parts = np.zeros(len(fine), np.int64), []
    for lo, hi in slices(offsets, STRETCH):
        base = offsets[lo]
        own = raw[base : offsets[hi]]
        start, end, counts[lo:hi] = text_pieces(own, offsets[lo : hi + 1] - base)
        keep = np.repeat(fine[lo:hi], counts[lo:hi])
        start, end = start[keep], end[keep]
        parts.append(((start + base).astype(np.int32), (end + base).astype(np.int32), hash_words(own, start, end, lower=False)))
    counts[~fine] = 0
    start, end, hashes = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate((np.int32, np.int32, np.uint64)))
    return start, end, counts, hashes


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, number of each place, occurrences) of the distinct hashes in order, as np.unique has them, in narrow types."""
    order = np.argsort(hashes, kind="stable").astype(np.int32)
    sorted_ = hashes[order]
    head = np.append(True, sorted_[1:] != sorted_[:-1]) if len(order) else np.zeros(0, bool)
    del sorted_
    number = np.empty(len(order), np.int32)
    number[order] = np.cumsum(head, dtype=np.int32) - 1
    return order[head], number, np.diff(np.append(np.flatnonzero(head), len(order)))


def _sliced(b_path: str):
    """Slices of the texts: keys, pieces of each text, each piece's number among the slice's distinct ones, and those with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        for batch in batches:
            whole, at = as_bytes(batch.column(1))
            for lo, hi in slices(at, SLICE):
                raw, offsets = whole[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
                fine = np.array([lossless(b, x.as_py() or "") for x in batch.column(1).slice(lo, hi - lo)], bool)
                start, end, counts, hashes = hashed_pieces(raw, offsets, fine)
                first, number, times = distinct(hashes)
                del hashes
                often = np.argsort(-times, kind="stable")  # frequent pieces get small numbers
                first, times, place = first[often], times[often], np.empty(len(often), np.int32)
                place[often] = np.arange(len(often))
                number = place[number]
                sizes = (end - start)[first]
                chars = raw[ranges(start[first], sizes)]
                pieces = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.py_buffer(chars)])
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays(
                    [one(batch.column(0).slice(lo, hi - lo)), one(pa.array(counts.astype(np.int32))), pa.array([shortened(number)], pa.binary()), one(pieces), one(pa.array(times.astype(np.int64)))],
                    ["keys", "counts", "numbers", "pieces", "times"],
                )
                del start, end, counts, first, number, times, often, place, sizes, chars, pieces
        # Loaded for the task alone: the worker goes on to other stages.
        del b
        trim()

    return run


#: A slice's parts: for each bucket that has any of its pieces, the sizes, counts and bytes of those.
DEALT = "counts array<int>, numbers binary, deal binary, parts array<struct<bucket: int, blob: binary>>"


def _dealt(b_path: str, n: int):
    """Slices whose distinct pieces are dealt out to n buckets by their hash; deal: the bucket of each."""
    slices_of = _sliced(b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of(batches):
            raw, offsets = as_bytes(batch.column("pieces")[0].values)
            sizes, times = np.diff(offsets), batch.column("times")[0].values.to_numpy()
            deal = hash_bucket(hash_words(raw, offsets[:-1], offsets[1:], lower=False), n)
            order = np.argsort(deal, kind="stable")
            edges = np.searchsorted(deal[order], np.arange(n + 1))
            filled = np.flatnonzero(np.diff(edges))
            own = [order[edges[k] : edges[k + 1]] for k in filled.tolist()]
            blobs = [squeezed([sizes[x].astype(np.uint32), times[x].astype(np.uint32), raw[ranges(offsets[x], sizes[x])]]) for x in own]
            parts = pa.StructArray.from_arrays([pa.array(filled.astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "blob"])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("keys", "counts", "numbers")), pa.array([shortened(deal)], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(parts)], pa.int32()), parts)],
                ["keys", "counts", "numbers", "deal", "parts"],
            )

    return run


#: A bucket's distinct pieces, each with an id (the bucket above 32 bits) and its occurrences, and the places among them of each slice's pieces.
MET = "bucket int, id bigint, n bigint, piece string, slice bigint, places binary"


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of all slices that a bucket has, and so a task, met."""
    give_back()
    of: dict[int, list[tuple[int, bytes]]] = {}
    for batch in batches:
        for s, bucket, blob in zip(*(batch.column(c).to_pylist() for c in ("slice", "bucket", "blob")), strict=True):
            of.setdefault(bucket, []).append((s, blob))
    kinds = {"bucket": pa.int32(), "id": pa.int64(), "n": pa.int64(), "piece": pa.string(), "slice": pa.int64(), "places": pa.binary()}

    def rows(**known) -> pa.RecordBatch:
        n = len(next(iter(known.values())))
        return pa.RecordBatch.from_arrays([pa.array(known[c], k) if c in known else pa.nulls(n, k) for c, k in kinds.items()], [*kinds])

    for bucket, parts in of.items():
        sizes, times, chars = zip(*(opened(blob, ["u4", "u4", "u1"]) for _, blob in parts), strict=True)
        at = np.append(0, np.cumsum(np.concatenate(sizes), dtype=np.int64))
        coded = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.concatenate(chars))]).dictionary_encode()
        del chars, at
        code, pieces = coded.indices.to_numpy(), coded.dictionary
        n = np.zeros(len(pieces), np.int64)
        np.add.at(n, code, np.concatenate(times).astype(np.int64))
        for lo, hi in slices(as_bytes(pieces)[1], STRETCH):
            own = pieces.slice(lo, hi - lo).cast(pa.string())
            yield rows(bucket=np.full(len(own), bucket), id=(bucket << 32) + np.arange(lo, hi), n=n[lo:hi], piece=own)
        edges = np.append(0, np.cumsum([len(x) for x in sizes]))
        for (s, _), lo, hi in zip(parts, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield rows(bucket=[bucket], slice=[s], places=[shortened(code[lo:hi])])


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's answers to each slice, in the order of the places. Takes (bucket, id, groups), (bucket, id, n_best, count_sum) and (bucket, slice, places) of one bucket, in any order."""
    give_back()
    parts: dict[str, list[pa.RecordBatch]] = {"groups": [], "n_best": [], "places": []}
    for batch in batches:
        for column, held in parts.items():
            held.append(batch.filter(batch.column(column).is_valid()))
    if not any(x.num_rows for x in parts["places"]):
        return
    asked = pa.Table.from_batches(parts.pop("places"))
    texts, sums = (pa.Table.from_batches(parts.pop(c)).sort_by("id") for c in ("groups", "n_best"))
    (bucket,) = asked.column("bucket").unique().to_pylist()
    want = (bucket << 32) + np.arange(len(texts))
    if any(not np.array_equal(x.column("id").to_numpy(), want) for x in (texts, sums)):
        raise ValueError(f"the pieces of bucket {bucket} have no or several answers")
    groups, best, count = texts.column("groups").combine_chunks(), sums.column("n_best").to_numpy(), sums.column("count_sum").to_numpy()
    for s, blob in zip(asked.column("slice").to_pylist(), asked.column("places").to_pylist(), strict=True):
        (at,) = opened(blob, ["u4"])
        raw, offsets = as_bytes(groups.take(pa.array(at)))
        answer = squeezed([np.diff(offsets).astype(np.uint32), best[at].astype(np.uint32), count[at], raw])
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([bucket], pa.int32()), pa.array([answer], pa.binary())], ["slice", "bucket", "blob"])


def group_sizes(groups: pa.Array) -> tuple[np.ndarray, ...]:
    """(n_a, n_b, n_groups, n_links) of each text's groups, from the marks in them, some texts at a time."""
    raw, offsets = as_bytes(groups)
    out = [np.zeros(len(groups), np.int64) for _ in range(4)]
    for lo, hi in slices(offsets, 1 << 19):
        for to, x in zip(out, _marks(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), strict=True):
            to[lo:hi] = x
    return tuple(out)


def _marks(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    count = lambda mask: np.diff(np.append(0, np.cumsum(mask, dtype=np.int64))[offsets])
    bar, comma = raw == ord("|"), raw == ord(",")
    # A comma is on side a if no bar has come since the last group began.
    side = np.append(0, np.cumsum(bar, dtype=np.int64) - np.cumsum(raw == ord(";"), dtype=np.int64))
    later = side[1:] > np.repeat(side[offsets[:-1]], np.diff(offsets))
    n = count(bar)
    a, b = count(comma & ~later) + n, count(comma & later) + n
    return a, b, n, a + b - n


def _put_together(names: list[str]):
    """Sums and the digest of the groups for each text of a slice. Its pieces' answers come first, by bucket, then the slice itself."""

    def texts(keys: pa.Array, counts: np.ndarray, numbers: bytes, deal: bytes, answers: list[bytes]) -> pa.RecordBatch:
        at = np.append(0, np.cumsum(counts)).astype(np.int64)
        sums, digests = [np.zeros(len(counts), np.int64) for _ in SUMS], [""] * len(counts)
        (bucket,) = opened(deal, ["u4"])
        if len(bucket):
            sizes, best, count, raw = (np.concatenate(x) for x in zip(*(opened(x, ["u4", "u4", "i8", "u1"]) for x in answers), strict=True))
            if len(sizes) != len(bucket):
                raise ValueError(f"{len(sizes)} answers to {len(bucket)} pieces")
            place = np.empty(len(bucket), np.int32)
            place[np.argsort(bucket, kind="stable")] = np.arange(len(bucket))
            number = place[lengthened(numbers, int(at[-1]))]
            offsets = np.append(0, np.cumsum(sizes, dtype=np.int64))
            whole, edges = raw.tobytes(), offsets.tolist()
            groups = [whole[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
            own = (*group_sizes(pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(whole)])), best, count)
            for lo, hi in slices(at, PIECES):
                mine = number[at[lo] : at[hi]]
                for x, out in zip(own, sums, strict=True):
                    runs = np.append(0, np.cumsum(x[mine], dtype=np.int64))[at[lo : hi + 1] - at[lo]]
                    out[lo:hi] = np.diff(runs)
                for r in range(lo, hi):
                    if counts[r]:
                        digests[r] = hashlib.sha256(b";".join([groups[i] for i in number[at[r] : at[r + 1]].tolist()])).hexdigest()
        return pa.RecordBatch.from_arrays([keys, *(pa.array(s) for s in sums), pa.array(digests, pa.string())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        answers: list[bytes] = []
        for batch in batches:
            for r, whole in enumerate(batch.column("whole").to_pylist()):
                if not whole:
                    answers.append(batch.column("blob")[r].as_py())
                    continue
                counts = batch.column("counts")[r].values.to_numpy()
                yield texts(batch.column("keys")[r].values, counts, *(batch.column(c)[r].as_py() for c in ("numbers", "deal")), answers)
                answers = []

    return run


def align_documents(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row."""
    kind = docs.schema[key].dataType.simpleString()
    # A number of its own, so that small slices and buckets are not gathered in one task.
    n = buckets(docs)
    sliced = docs.select(named(key).alias("key"), named(text).alias("text")).mapInArrow(_dealt(b_path, n), f"keys array<{kind}>, {DEALT}")
    sliced = cut(sliced.withColumn("slice", F.monotonically_increasing_id()), "slices", "zstd")
    parts = sliced.select("slice", F.explode("parts").alias("p")).select("slice", "p.bucket", "p.blob")
    met = cut(parts.repartitionById(n, F.col("bucket")).mapInArrow(_met, MET), "pieces", "zstd")
    texts = cut(gathered(align(encode_pieces(met.where("piece IS NOT NULL"), a_path, b_path))), "aligned", "zstd")
    # What a bucket knows and is asked meets in its task.
    bucket = F.shiftright("id", 32).cast("int").alias("bucket")
    known = texts.select(bucket, "id", "groups").unionByName(link_sums(texts).select(bucket, "id", "n_best", "count_sum"), allowMissingColumns=True)
    known = known.unionByName(met.where("places IS NOT NULL").select("bucket", "slice", "places"), allowMissingColumns=True)
    answers = known.repartitionById(n, F.col("bucket")).mapInArrow(_answered, "slice bigint, bucket int, blob binary")
    rows = answers.select("slice", F.lit(0).alias("whole"), "bucket", "blob").unionByName(sliced.select("slice", F.lit(1).alias("whole"), "keys", "counts", "numbers", "deal"), allowMissingColumns=True)
    whole = rows.repartition(n, "slice").sortWithinPartitions("slice", "whole", "bucket")
    names = [key, *SUMS, "groups_sha256"]
    return whole.mapInArrow(_put_together(names), f"`{key.replace('`', '``')}` {kind}, " + ", ".join(f"{c} bigint" for c in SUMS) + ", groups_sha256 string")
