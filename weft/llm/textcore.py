"""Word boundaries and word hashes of Arrow text columns, in numpy over the raw UTF-8 buffer.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. All of these are
ASCII, so splitting bytes equals splitting code points. No Python string is built.
Hashes are 64-bit polynomial hashes over a random byte table with a final mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .memory import give_back

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20_240_517))
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_STEP = U64(0xD1342543DE82EF95)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text hashed at once; bounds the temporary arrays to some 100 MB.
SLICE_BYTES = 2 << 20
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to at least n."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES) + 1
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            _powers[name] = np.multiply.accumulate(run)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that all bits depend on all bits."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its len + 1 offsets into them; null rows are empty."""
    give_back()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most that many bytes each; a longer row stands alone."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end


def spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the number of the first word (len + 1 entries)."""
    inside = ~_SEPARATOR[raw]
    n = len(raw)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    finishes = inside.copy()
    finishes[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begins[cuts] = inside[cuts]
    finishes[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return start, end, np.searchsorted(start, offsets)


def hash_words(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each word's bytes, with A-Z taken as a-z if lower."""
    out = np.empty(len(start), np.uint64)
    table = _LOWER if lower else _TABLE
    first = 0
    while first < len(start):
        last = int(np.searchsorted(end, start[first] + SLICE_BYTES, "right"))
        last = max(last, first + 1)
        lo, hi = int(start[first]), int(end[last - 1])
        up, down = _power_table(hi - lo)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[raw[lo:hi]] * up[: hi - lo], out=sums[1:])
        s, e = start[first:last] - lo, end[first:last] - lo
        out[first:last] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        first = last
    return out


def ngrams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words, by doubling; element i covers words i to i + k - 1."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, size, run = words, 1, None
    done, left, step = 0, k, _STEP
    while True:
        if left & 1:
            run = power[:n].copy() if run is None else run * step + power[done : done + n]
            done += size
        left >>= 1
        if not left:
            break
        power = power[: len(power) - size] * step + power[size:]
        step = mix(np.array([step], np.uint64))[0] | U64(1)
        size *= 2
    return mix(run)


def windows(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all k-word windows that stay in one row, and the row of each; first as from spans()."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) - begin[rows] + first[:-1][rows], rows


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one after another."""
    total = int(counts.sum())
    begin = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(np.asarray(starts, np.int64) - begin, counts)


def hash_bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    """Buckets of well-mixed 64-bit hashes as n equal ranges: what is sorted by hash is sorted by bucket too."""
    return ((hashes >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def _rotate(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def spark_xxhash64(values: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64(bigint) gives, as signed 64-bit integers."""
    p1, p2, p3, p4, p5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    with np.errstate(over="ignore"):
        h = _rotate(np.asarray(values, np.int64).view(np.uint64) * p2, 31) * p1 ^ (U64(42) + p5 + U64(8))
        h = _rotate(h, 27) * p1 + p4
        h ^= h >> U64(33)
        h *= p2
        h ^= h >> U64(29)
        h *= p3
        h ^= h >> U64(32)
    return h.view(np.int64)


def bucket_of(ids: np.ndarray, n: int) -> np.ndarray:
    """The same bucket as pmod(xxhash64(id), n) in Spark."""
    return np.mod(spark_xxhash64(ids), n).astype(np.int64)
