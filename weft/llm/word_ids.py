"""Token ids of whole texts with the tokenizers library, each distinct unit of words encoded once.

The tokenizer splits at white space before merging, so a text's ids are its words' ids
in order. Strings of special tokens in a text become those tokens, as the library's plain
call has it; none of them holds white space, so they lie within words.

Where the tokenizer has the normalizer and the pattern named here, words of ASCII and Latin-1 letters,
digits and signs are put in lower case and cut into the pattern's units by byte classes, all words of
some texts at once; Arrow tells distinct units apart, and each new one goes through the library's merges once; a
token with the end mark ends a unit. No Python object is made for a word. All other words (an
apostrophe begins contractions, `<|` special tokens) are units of their own and take the library's
whole way; those new to the worker are encoded together in one call, with a control character between
them that gives a token of its own. Such a word holds a character that no other unit has, so one cache serves both.

Spark keeps its workers from stage to stage, and what one holds counts against the executor while
others run. So a cache that has grown is cut back to what was asked for again: by settle(), which
callers use at a task's end, and beyond CACHE_ENTRIES.
"""

from __future__ import annotations

import json
import re
from itertools import compress, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .memory import trim
from .textcore import ranges

FENCE = "\x01"
#: Units, from which on the cache is cut back before more are learned; most that stay then, and between tasks.
CACHE_ENTRIES, KEPT_ENTRIES = 500_000, 120_000
CALL_WORDS = 4000
#: What the units below stand for; a tokenizer with anything else goes the whole way.
NORMALIZER = [("NFC", None), ("Replace", "\\s+"), ("Lowercase", None)]
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: What sends a word the whole way: all but the characters that NFC leaves alone and whose lower case is one character for each; apostrophes and `<|`.
_OTHER = re.compile(r"[^!-&(-~À-ÖØ-öø-ÿ]|<\|")
_SPECIAL = re.compile(rb"<\|")
_SPACE, _LETTER, _DIGIT, _SIGN, _STRANGE = range(5)
#: Classes of bytes. 0xC3 leads U+00C0 to U+00FF, letters but for two signs, see _classes().
_CLASS = np.full(256, _STRANGE, np.uint8)
_CLASS[0x21:0x7F] = _SIGN
_CLASS[list(b" \t\n\v\f\r")] = _SPACE
_CLASS[list(b"0123456789")] = _DIGIT
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), 0xC3]] = _LETTER
_CLASS[ord("'")] = _STRANGE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def splits_as_named(tokenizer) -> bool:
    """Whether the tokenizer's normalizer, pattern and end mark are those that the units are made for."""
    told = json.loads(tokenizer.to_str())
    steps = (told["normalizer"] or {}).get("normalizers", [])
    splits = (told["pre_tokenizer"] or {}).get("pretokenizers", [])
    return (
        [(x["type"], x.get("pattern", {}).get("Regex")) for x in steps] == NORMALIZER
        and [x["type"] for x in splits] == ["Split", "ByteLevel"]
        and (splits[0]["pattern"].get("Regex"), splits[0]["behavior"], splits[0]["invert"]) == (PATTERN, "Removed", True)
        and not (splits[1]["add_prefix_space"] or splits[1]["use_regex"])
        and told["model"]["type"] == "BPE"
        and told["model"]["end_of_word_suffix"] == "</w>"
        and not told["model"].get("dropout")
        and all(x["content"].startswith("<|") and not x["normalized"] for x in told["added_tokens"])
    )


def _classes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each byte of UTF-8, and the bytes in lower case (right where no byte of the word is strange)."""
    kind, low = _CLASS[raw], _LOWER[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    second = raw[lead + 1]
    kind[lead[(second == 0x97) | (second == 0xB7)]] = _STRANGE
    low[lead[(second >= 0x80) & (second <= 0x9E)] + 1] += 0x20
    return kind, low


def _begins(kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the class of bytes changes to another than white space, or a text begins with such."""
    out = kind != _SPACE
    first = offsets[offsets < len(kind)]
    at_first = out[first]
    out[1:] &= kind[1:] != kind[:-1]
    out[first] = at_first
    return out


def _packed(held: dict[bytes, bytes]) -> tuple[bytes, bytes, np.ndarray]:
    """The first KEPT_ENTRIES as three large objects: keys, which hold no space, values, and where those end."""
    keys, values = list(islice(held, KEPT_ENTRIES)), list(islice(held.values(), KEPT_ENTRIES))
    return b" ".join(keys), b"".join(values), np.cumsum([len(v) for v in values], dtype=np.int64)


def _unpacked(keys: bytes, values: bytes, ends: np.ndarray) -> dict:
    edges = [0, *ends.tolist()]
    return dict(zip(keys.split(b" ") if len(ends) else (), map(values.__getitem__, map(slice, edges, edges[1:])), strict=True))


class WordIds:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        fence = self._call(FENCE)
        self.fence = int(fence[0]) if len(fence) == 1 else None
        self.once: dict[bytes, bytes] = {}
        self.again: dict[bytes, bytes] = {}
        self.merges = None
        if splits_as_named(self.tokenizer):
            from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

            self.merges = Tokenizer(self.tokenizer.model)
            self.merges.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _call(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn_units(self, units: list[str]) -> list[bytes] | None:
        """Ids of units that the pattern gives; none if they could not be told apart."""
        out = []
        for at in range(0, len(units), CALL_WORDS):
            some = units[at : at + CALL_WORDS]
            ids = np.array(self.merges.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some) or ends[-1] != len(ids):
                return None
            raw, edges = ids.tobytes(), [0, *(4 * ends).tolist()]
            out.extend(map(raw.__getitem__, map(slice, edges, edges[1:])))
        return out

    def _learn(self, units: list[bytes], into: dict[bytes, bytes]) -> None:
        if units and self.merges is not None:
            texts = b" ".join(units).decode().split(" ")
            plain, strange = units, []
            if _OTHER.search("".join(texts)):
                odd = list(map(bool, map(_OTHER.search, texts)))
                strange, plain = list(compress(units, odd)), [u for u, o in zip(units, odd, strict=True) if not o]
                texts = [s for s, o in zip(texts, odd, strict=True) if not o]
            ids = self._learn_units(texts)
            if ids is not None:
                into.update(zip(plain, ids, strict=True))
                units = strange
        fenced = []
        for u in units:
            if self.fence is None or FENCE.encode() in u:
                into[u] = self._call(u.decode()).tobytes()
            else:
                fenced.append(u)
        for at in range(0, len(fenced), CALL_WORDS):
            some = fenced[at : at + CALL_WORDS]
            ids = self._call(f" {FENCE} ".join(u.decode() for u in some))
            ends = np.append(np.flatnonzero(ids == self.fence), len(ids))
            if len(ends) != len(some):  # another route to the fence's token
                for u in some:
                    into[u] = self._call(u.decode()).tobytes()
                continue
            start = 0
            for u, end in zip(some, ends.tolist(), strict=True):
                into[u] = ids[start:end].tobytes()
                start = end + 1

    def _cut(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all units one after another, where each begins there, and how many stand before each text."""
        kind, low = _classes(raw)
        inside = kind != _SPACE
        if self.merges is None:
            begins, low = _begins(inside.view(np.uint8), offsets), raw
        else:
            begins = _begins(kind, offsets) | (kind == _DIGIT)
            marks = np.array([m.start() for m in _SPECIAL.finditer(raw)], np.int64)
            marks = marks[~np.isin(marks + 1, offsets)]  # not where one text ends and the next begins
            odd = np.append(np.flatnonzero(kind == _STRANGE), marks)
            if len(odd):
                # Bytes of words that go the whole way stay as they are and uncut.
                words = np.flatnonzero(_begins(inside.view(np.uint8), offsets))
                own = np.unique(np.searchsorted(words, odd, "right") - 1)
                edges = np.append(words, len(raw))
                depth = np.zeros(len(raw) + 1, np.int8)
                depth[edges[own]] += 1
                depth[edges[own + 1]] -= 1
                whole = np.cumsum(depth[:-1], dtype=np.int8).view(bool)
                low = np.where(whole, raw, low)
                begins &= ~whole
                begins[words[own]] = True
        before = np.searchsorted(np.flatnonzero(begins), offsets)
        return low[inside], np.flatnonzero(begins[inside]), before

    def encode_column(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and len + 1 offsets into them; texts as textcore.as_bytes() has them."""
        if len(self.once) + len(self.again) > CACHE_ENTRIES:
            self.settle()
        data, starts, before = self._cut(raw, offsets)
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        bounds = pa.py_buffer(np.append(starts, len(data)).astype(np.int32))
        told = pa.Array.from_buffers(pa.binary(), len(starts), [None, bounds, pa.py_buffer(data)]).dictionary_encode()
        which, some = told.indices.to_numpy(), told.dictionary
        # Units hold no space; splitting is the quickest way to their bytes.
        distinct = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), b" ")[0].as_py().split(b" ")
        found = self._found(distinct)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        counts = size[which]
        ids = np.frombuffer(b"".join(found), "<u4")[ranges((np.cumsum(size) - size)[which], counts)]
        return ids, np.append(0, np.cumsum(counts))[before]

    def _found(self, distinct: list[bytes]) -> list[bytes]:
        """Ids of each unit, learned if new; those asked for a second time move to again."""
        found = list(map(self.again.get, distinct))
        rare = [i for i, ids in enumerate(found) if ids is None]
        new = []
        for i in rare:
            unit = distinct[i]
            ids = self.once.pop(unit, None)
            if ids is None:
                new.append(unit)
            else:
                found[i] = self.again[unit] = ids
        self._learn(new, self.once)
        for i in rare:
            if found[i] is None:
                found[i] = self.once[distinct[i]]
        return found

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        offsets = np.cumsum([0, *map(len, texts)])
        ids, at = self.encode_column(np.frombuffer(b"".join(texts), np.uint8), offsets)
        return [ids[lo:hi].tobytes() for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def settle(self) -> None:
        """Cuts the cache back to what was asked for again, if it holds more than may stay.

        What stays is copied behind what goes, as single entries would hold on to the memory around them.
        """
        if len(self.once) + len(self.again) <= KEPT_ENTRIES:
            return
        kept = _packed(self.again)
        self.once, self.again = {}, {}
        trim()
        self.once = _unpacked(*kept)


_made: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One for each Python worker and path."""
    if path not in _made:
        _made[path] = WordIds(path)
    return _made[path]
