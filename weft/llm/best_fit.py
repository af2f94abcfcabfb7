"""Best-fit packing by minimum bin slack over the histogram of lengths.

1. Each document is encoded once; longer ones are cut into full sequences, which stand
   alone, and a remainder. Only (id, start, length, checksum) leave the workers.
2. The remainders are counted by length: at most capacity - 1 counts, whatever the
   number of documents. On this histogram the driver fills bin after bin: the longest
   length left is fixed, and a bitset subset-sum over the lengths available finds the
   fullest feasible combination. It is removed as often as the counts allow, so the
   number of steps follows the number of lengths and not the number of bins.
3. The plan (lengths x few slots) is broadcast, bounded by the capacity. Each remainder
   takes the slot of its rank within its length. Ranks come from counts by (length,
   salt): up to SALTS salts for frequent lengths, and one for each RANKED rows of the most
   frequent ones, so that no task ranks more of them however many rows one length has.

Null text counts as empty: a document of the end token alone. Rows that repeat an id are
packed as rows of their own. A null id is packed too. Ties in length are ranked by id,
piece and checksum. An empty table gives an empty result. Very long texts become as many
pieces as they need.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .exchange import cut, ddl, named
from .textcore import as_bytes, slices
from .word_ids import word_ids

CAPACITY, END_ID, RANKED, SALTS, SALTED = 2048, 0, 1 << 20, 64, 256
#: Bytes of text that are split into units at once; a longer text goes alone.
CALL_BYTES = 4 << 20


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32) of each document's ids with the end id."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(path)
        end = np.uint32(end_id).tobytes()
        for batch in batches:
            raw, at = as_bytes(batch.column(1))
            for lo, hi in slices(at, CALL_BYTES):
                row, piece, start, length, crc = [], [], [], [], []
                found, edges = ids_of.encode_column(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                for r, (a, b) in enumerate(pairwise(edges.tolist()), lo):
                    ids = found[a:b].tobytes() + end
                    n = b - a + 1
                    for p, s in enumerate(range(0, n, capacity)):
                        row.append(r)
                        piece.append(p)
                        start.append(s)
                        length.append(min(capacity, n - s))
                        crc.append(zlib.crc32(ids[4 * s : 4 * (s + capacity)]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    [batch.schema.names[0], "piece", "start", "length", "ids_crc32"],
                )
        ids_of.settle()

    return docs.select(named(key), named(text)).mapInArrow(run, f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """[([(length, copies in a bin), ...], number of bins), ...] by minimum bin slack."""
    left = {n: c for n, c in counts.items() if c > 0}
    out = []
    full = (1 << (capacity + 1)) - 1
    while left:
        lengths = sorted(left, reverse=True)
        fixed = lengths[0]
        room = capacity - fixed
        # reach[k]: sums that the first k of the usable lengths make, as bits.
        usable = [n for n in lengths if n <= room]
        reach, steps = 1, []
        target = 1 << room
        for n in usable:
            have = min(left[n] - (n == fixed), room // n)
            shift = 1
            while have > 0:
                take = min(shift, have)
                steps.append((n, take, reach))
                reach |= (reach << (n * take)) & full
                have -= take
                shift *= 2
            if reach & target:
                break
        reach &= (1 << (room + 1)) - 1
        rest = reach.bit_length() - 1
        chosen = {fixed: 1}
        for n, take, before in reversed(steps):
            if not (before >> rest) & 1:
                rest -= n * take
                chosen[n] = chosen.get(n, 0) + take
        bins = min(left[n] // k for n, k in chosen.items())
        out.append((sorted(chosen.items(), reverse=True), bins))
        for n, k in chosen.items():
            left[n] -= k * bins
            if not left[n]:
                del left[n]
    return out


def slots(planned: list[tuple[list[tuple[int, int]], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: (first rank, copies, first bin, offset) of its slots, pattern by pattern."""
    by: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for chosen, bins in planned:
        offset = 0
        for n, k in chosen:
            by.setdefault(n, []).append((used.get(n, 0), k, first, offset))
            used[n] = used.get(n, 0) + k * bins
            offset += n * k
        first += bins
    return {n: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for n, v in by.items()}


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """The pieces with sequence_id and offset. cut_pieces is read several times and should be a written table."""
    full = cut_pieces.where(F.col("length") == capacity)
    rest = cut_pieces.where(F.col("length") < capacity)
    # At most capacity - 1 rows, however many documents.
    total = {r["length"]: r["n"] for r in rest.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    planned = plan(total, capacity)
    placed, bins = slots(planned), sum(b for _, b in planned)
    salts = {n: max(-(-c // RANKED), min(SALTS, -(-c // SALTED))) for n, c in total.items()}
    table = F.broadcast(rest.sparkSession.createDataFrame(list(salts.items()), "length bigint, salts int"))
    salt = F.pmod(F.xxhash64(named(key), "piece", "ids_crc32"), F.col("salts")).cast("int")
    rest = rest.join(table, "length").withColumn("salt", salt).drop("salts")
    # At most capacity x SALTS rows, and one more for each RANKED documents.
    counts = rest.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).collect()
    ahead: dict[tuple[int, int], int] = {}
    before: dict[int, int] = {}
    for r in sorted(counts, key=lambda r: (r["length"], r["salt"])):
        ahead[r["length"], r["salt"]] = before.get(r["length"], 0)
        before[r["length"]] = before.get(r["length"], 0) + r["n"]
    ranked = rest.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy(named(key), "piece", "ids_crc32")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            length, salt, rank = (batch.column(names.index(c)).to_numpy() for c in ("length", "salt", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                own = np.flatnonzero(length == n)
                r = rank[own].astype(np.int64) - 1 + np.array([ahead.get((n, s), 0) for s in salt[own].tolist()], np.int64)
                begin, copies, first, at = placed[n]
                k = np.searchsorted(begin, r, "right") - 1
                slot = r - begin[k]
                sequence[own] = first[k] + slot // copies[k]
                offset[own] = at[k] + slot % copies[k] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in out_names[:-2]), pa.array(sequence), pa.array(offset)], out_names)

    out_names = [*cut_pieces.columns, "sequence_id", "offset"]
    schema = ddl(cut_pieces.schema) + ", sequence_id bigint, offset bigint"
    packed = ranked.mapInArrow(place, schema)
    # Full pieces stand alone: numbers that no two tasks share, above those of the planned bins.
    alone = full.withColumn("sequence_id", F.monotonically_increasing_id() + F.lit(bins)).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(alone)


def best_fit_packing(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: key, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(cut(pieces(docs, path, capacity, end_id, key, text), "pieces"), capacity, key)
