"""SentencePiece encoding and decoding by a merge-type prefix table.

For byte-pair merging every prefix of a text has exactly one last token. The table
stores it: an Aho-Corasick automaton gives all pieces that end at a place, and the
one is taken whose pair with the last token of the prefix before it is compatible,
that is, whose merge order would not have joined anything across their border. The
ids are then recovered backwards through the table, in time linear in the text.

No piece of the model holds a word mark after another character, so a text falls
into chunks (word marks and what follows them) that never merge across; chunks repeat,
and their ids are kept in a bounded cache.

Null text counts as empty (begin and end ids only). Rows are encoded one by one, so
repeated rows and empty tables need nothing special. Very long texts and very long
chunks take linear time; a chunk over CACHE_CHARS characters is not cached.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .exchange import named

MARK = "▁"
#: Chunks kept in each of the cache's two generations, and the longest that is kept.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 64
#: Pairs kept in each generation of the compatibility tests.
PAIR_ENTRIES = 1_000_000


class PieceModel:
    """Pieces of a merge-type model, read through the library's accessors; nothing is encoded with it."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.bos, self.eos, self.unk = lib.bos_id(), lib.eos_id(), lib.unk_id()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        self.byte_ids: dict[int, int] = {}
        self.of: dict[str, int] = {}
        self.rank: list[float] = [0.0] * n
        self.text: list[bytes] = [b""] * n
        self.is_byte = np.zeros(n, bool)
        for i, piece in enumerate(self.pieces):
            if lib.is_byte(i):
                b = int(piece[3:5], 16)
                self.byte_ids[b], self.text[i], self.is_byte[i] = i, bytes([b]), True
            elif not lib.is_control(i) and not lib.is_unknown(i) and not lib.is_unused(i):
                self.of[piece] = i
                self.rank[i] = -lib.get_score(i)
                self.text[i] = piece.replace(MARK, " ").encode()
        self.text[self.unk] = " ⁇ ".encode()
        if any(MARK in p.lstrip(MARK) for p in self.of):
            raise ValueError("a piece holds a word mark after another character: chunks would not be independent")
        # Compatible pairs in two bounded generations, as the chunks below; keys are this model's ids.
        self._pairs: dict[tuple[int, int], bool] = {}
        self._old_pairs: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.of.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.parts = self._parts()
        self.alone = {i: self.encode_chunk(p) == [i] for p, i in sorted(self.of.items(), key=lambda x: len(x[0]))}
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        lengths = np.array([len(t) for t in self.text], np.int64)
        self._lengths, self._starts = lengths, np.cumsum(lengths) - lengths
        self._bytes = np.frombuffer(b"".join(self.text), np.uint8)

    def _parts(self) -> dict[int, tuple[int, int] | None]:
        """The last merge that makes each piece out of its characters; None for single characters and for pieces that merging never reaches."""
        parts: dict[int, tuple[int, int] | None] = {}
        for piece, i in self.of.items():
            symbols = list(piece)
            last = None
            while len(symbols) > 1:
                best, where = None, -1
                for k in range(len(symbols) - 1):
                    j = self.of.get(symbols[k] + symbols[k + 1])
                    if j is not None and (best is None or self.rank[j] < best):
                        best, where = self.rank[j], k
                if best is None:
                    last = None
                    break
                last = (symbols[where], symbols[where + 1])
                symbols[where : where + 2] = ["".join(last)]
            parts[i] = (self.of.get(last[0], -1), self.of.get(last[1], -1)) if last and len(symbols) == 1 else None
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves a and b as neighbours: undo the later of both pieces' last merges until nothing is left to undo,
        and see that no pair across the border would have been merged before the merge undone."""
        known = self._pairs.get((a, b))
        if known is None:
            known = self._old_pairs.get((a, b))
            if known is None:
                known = self._compatible(a, b)
            if len(self._pairs) >= PAIR_ENTRIES:
                self._old_pairs, self._pairs = self._pairs, {}
            self._pairs[a, b] = known
        return known

    def _compatible(self, a: int, b: int) -> bool:
        left, right, pieces, rank, parts = a, b, self.pieces, self.rank, self.parts
        limit, strict = float("inf"), False
        while True:
            joined = self.of.get(pieces[left] + pieces[right])
            # The pair is taken if its rank is lower; on equal rank, the leftmost goes first.
            if joined is not None and (rank[joined] < limit or rank[joined] == limit and strict):
                return False
            lp, rp = parts.get(left), parts.get(right)
            if lp is None and rp is None:
                return True
            # The later merge of the two is undone first: the higher rank; on a tie the right one came later.
            if rp is None or lp is not None and rank[left] > rank[right]:
                limit, strict, left = rank[left], False, lp[1]
            else:
                limit, strict, right = rank[right], True, rp[0]

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a chunk whose characters are all in the vocabulary, or with byte ids for those that are not."""
        n = len(chunk)
        last: list[int] = [-1] * (n + 1)
        size: list[int] = [1] * (n + 1)
        missing = -2
        parts, known = self.parts, self._pairs.get
        found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(chunk):
            found[end].append(match)
        for end in range(1, n + 1):
            own = missing
            for length, piece in found[end - 1]:
                start = end - length
                if length > 1 and parts[piece] is None:
                    continue
                before = last[start]
                if start == 0 or before == missing:
                    ok = True
                else:
                    ok = known((before, piece))
                    if ok is None:
                        ok = self.compatible(before, piece)
                if ok:
                    own, size[end] = piece, length
                    break
            last[end] = own
        out: list[int] = []
        end = n
        while end:
            if last[end] == missing:
                out += [self.byte_ids.get(b, self.unk) for b in reversed(chunk[end - 1].encode())] if self.byte_ids else [self.unk]
                end -= 1
            else:
                out.append(last[end])
                end -= size[end]
        out.reverse()
        return out

    def _packed(self, chunk: str) -> bytes:
        got = self._young.get(chunk)
        if got is None:
            got = self._old.get(chunk)
            if got is None:
                got = np.array(self.encode_chunk(chunk), "<u4").tobytes()
            if len(chunk) <= CACHE_CHARS:
                if len(self._young) >= CACHE_ENTRIES:
                    self._old, self._young = self._young, {}
                self._young[chunk] = got
        return got

    #: Word marks with what follows up to the next mark.
    _chunk = re.compile(f"{MARK}+[^{MARK}]*")

    def encode(self, text: str) -> np.ndarray:
        """Ids with begin and end, as little-endian unsigned 32-bit integers."""
        if not text:
            return np.array([self.bos, self.eos], "<u4")
        marked = MARK + text.replace(" ", MARK)
        get, packed = self._young.get, self._packed
        out = [got if (got := get(c)) is not None else packed(c) for c in self._chunk.findall(marked)]
        return np.frombuffer(np.uint32(self.bos).tobytes() + b"".join(out) + np.uint32(self.eos).tobytes(), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """Joins the pieces, drops the mark that encoding put in front, and reads runs of byte pieces as UTF-8."""
        ids = np.asarray(ids, np.int64)
        ids = ids[(ids != self.bos) & (ids != self.eos)]
        if not len(ids):
            return ""
        front = 1 if not self.is_byte[ids[0]] and self.pieces[ids[0]].startswith(MARK) else 0
        size = self._lengths[ids]
        begin = np.cumsum(size) - size
        raw = self._bytes[np.arange(int(size.sum())) + np.repeat(self._starts[ids] - begin, size)].tobytes()
        try:
            return raw[front:].decode()
        except UnicodeDecodeError:
            return self._decode_slowly(ids, front)

    def _decode_slowly(self, ids: np.ndarray, front: int) -> str:
        """Byte runs that are not UTF-8: one replacement character for each byte that begins nothing valid."""
        out, run = [], bytearray()

        def flush():
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + n]).decode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run.clear()

        for i in ids.tolist():
            if self.is_byte[i]:
                run += self.text[i]
            else:
                flush()
                out.append(self.text[i].decode())
        flush()
        return "".join(out)[front:]


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """One model for each Python worker and path."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>, decoded string): each whole text encoded and decoded again."""
    return docs.select(named(key).alias("key"), named(text).alias("text")).mapInArrow(_ids(path, key), _schema(docs, key, "ids array<int>, decoded string"))


def digest_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256), without moving ids out of the workers."""
    return docs.select(named(key).alias("key"), named(text).alias("text")).mapInArrow(_digests(path, key), _schema(docs, key, "n_tokens bigint, ids_sha256 string, decoded_sha256 string"))


def _schema(docs: DataFrame, key: str, rest: str) -> str:
    return f"`{key.replace('`', '``')}` {docs.schema[key].dataType.simpleString()}, {rest}"


def _ids(path: str, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids = [m.encode(x or "") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())), pa.array([m.decode(i) for i in ids], pa.string())], [key, "ids", "decoded"])

    return run


def _digests(path: str, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            n, a, b = [], [], []
            for x in batch.column(1):
                ids = m.encode(x.as_py() or "")
                n.append(len(ids))
                a.append(hashlib.sha256(ids.tobytes()).hexdigest())
                b.append(hashlib.sha256(m.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return run
