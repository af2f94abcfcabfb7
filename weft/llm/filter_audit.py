"""Filter interaction audit by a packed bitmap index.

Which document fails which filter is a bit; documents of one part stand in 64-bit words of
their own, so a part is a range of words. Each partition packs its rows into NumPy bitsets,
one for each filter and label. What survives a set of filters is the survivors of the set
without its last filter AND NOT that filter's bits; popcounts for each part and each of the
2**k sets, alone and within each label, are all that leaves a partition, and they add up.
Every order of the filters follows from these counts: the survivors of a prefix do not
depend on its order.

text_failures() judges texts, with_repeats() adds the filter that looks at the whole table,
survivors() counts, orders() lists all orders of the filters step by step.

Null texts are empty, null parts the empty string. A null id fails no comparison with smaller
ids and has no labels. Rows that repeat an id are rows of their own: equal ids are not smaller
than each other, and each gets the id's labels (set where any of the id's label rows is 1). An
empty table gives an empty result. Input columns are read by name and others ignored, so no
name can clash. Very long texts are judged whole. Equal texts are told by 128 bits of hash,
distinct words within a text by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import ddl, named
from .textcore import as_bytes, hash_words, slices, spans

#: Production thresholds: fewest words, least percentage of distinct words, largest percentage of upper-case letters, characters that must not occur.
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, SYMBOLS = 50, 65, 5, "#$%&*|"
FILTERS = "ABCDE"
#: Parts whose counts a task holds before it sends them on.
PARTS_HELD = 20_000


def _judge(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The failed filters among A to D of each text, as bits."""
    n = len(offsets) - 1
    start, end, first = spans(raw, offsets)
    words = np.diff(first)
    row = np.repeat(np.arange(n), words)
    hashes = hash_words(raw, start, end, lower=False)
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    distinct = np.bincount(row[new], minlength=n)

    def within(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(mask, dtype=np.int64))[offsets])

    upper = within((raw >= 65) & (raw <= 90))
    chars = within((raw & 0xC0) != 0x80)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True
    fails = (words < MIN_WORDS, 100 * distinct < DISTINCT_PERCENT * words, 100 * upper > UPPER_PERCENT * chars, within(symbol[raw]) > 0)
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails)) + np.zeros(n, np.int32)


def text_failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(id, part, fails, t1, t2) for each row: the failed filters A to D as bits, and the text's 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = as_bytes(batch.column(4))
            out = [_judge(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in slices(offsets)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.concatenate(out) if out else np.zeros(0, np.int32), pa.int32())], ["id", "part", "t1", "t2", "fails"])

    t = F.coalesce(named(text), F.lit(""))
    base = docs.select(named(key).alias("id"), F.coalesce(named(part).cast("string"), F.lit("")).alias("part"), F.xxhash64(t).alias("t1"), F.xxhash64(F.lit(1), t).alias("t2"), t.alias("text"))
    return base.mapInArrow(run, ddl(base.schema.fields[:4]) + ", fails int")


def with_repeats(judged: DataFrame, bit: int) -> DataFrame:
    """Sets the bit in fails of each row whose text also stands under a smaller id.

    Only the smallest id of a text passes. The join is on text and id together, so that a text
    that a third of all rows hold is dealt out by their ids.
    """
    firsts = judged.where("id IS NOT NULL").groupBy("t1", "t2").agg(F.min("id").alias("id"), F.lit(True).alias("is_first"))
    again = F.col("id").isNotNull() & F.col("is_first").isNull()
    return judged.join(firsts, ["t1", "t2", "id"], "left").select("id", "part", F.col("fails").bitwiseOR(F.when(again, 1 << bit).otherwise(0)).alias("fails"))


def with_labels(judged: DataFrame, labels: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(part, fails, labels): bits of the labels that are 1 for the row's id."""
    bits = [F.max(F.when(named(c) == 1, 1 << k).otherwise(0)) for k, c in enumerate(columns)]
    known = labels.where(named(key).isNotNull()).groupBy(named(key).alias("id")).agg(sum(bits[1:], bits[0]).alias("labels"))
    return judged.join(known, "id", "left").select("part", "fails", F.coalesce("labels", F.lit(0)).alias("labels"))


def pack_parts(code: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of each row in the index, first word of each part and the end): parts begin at whole 64-bit words."""
    counts = np.bincount(code, minlength=parts)
    words = np.append(0, np.cumsum(-(-counts // 64)))
    order = np.argsort(code, kind="stable")
    place = np.empty(len(code), np.int64)
    place[order] = np.arange(len(code)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(64 * words[:-1], counts)
    return place, words


def bitset(flags: np.ndarray, place: np.ndarray, words: int) -> np.ndarray:
    """Flags at their places as 64-bit words."""
    wide = np.zeros(64 * words, bool)
    wide[place] = flags
    return np.packbits(wide, bitorder="little").view(np.uint64)


def subset_counts(code: np.ndarray, parts: int, fails: np.ndarray, labels: np.ndarray, k: int, m: int) -> np.ndarray:
    """Rows of each part that fail no filter of each set: [part, label + 1 (0: all), set]."""
    place, words = pack_parts(code, parts)
    bits = [bitset((fails >> f) & 1 > 0, place, int(words[-1])) for f in range(k)]
    marks = [bitset((labels >> j) & 1 > 0, place, int(words[-1])) for j in range(m)]
    alive = {0: bitset(np.ones(len(code), bool), place, int(words[-1]))}
    out = np.zeros((parts, m + 1, 1 << k), np.int64)
    for s in range(1 << k):
        if s:
            top = s.bit_length() - 1
            alive[s] = alive[s ^ (1 << top)] & ~bits[top]
        for j, own in enumerate((alive[s], *(alive[s] & x for x in marks))):
            out[:, j, s] = np.add.reduceat(np.bitwise_count(own).astype(np.int64), words[:-1])
    return out


def survivors(judged: DataFrame, k: int, labels: list[str]) -> DataFrame:
    """(part, n array<bigint>, one such array for each label): rows that pass all filters of each of the 2**k sets.

    Takes (part, fails, labels). A partition sends one row for each of its parts, or a few if it has very many.
    """
    m, size = len(labels), 1 << k
    names = [f"c{i}" for i in range((m + 1) * size)]

    def rows(held: dict[str, np.ndarray]) -> pa.RecordBatch:
        table = np.stack(list(held.values()))
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *(pa.array(table[:, i]) for i in range(table.shape[1]))], ["part", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            counts = subset_counts(coded.indices.to_numpy(), len(coded.dictionary), batch.column(1).to_numpy(), batch.column(2).to_numpy(), k, m)
            for part, own in zip(coded.dictionary.to_pylist(), counts.reshape(len(counts), -1), strict=True):
                held[part] = held[part] + own if part in held else own
            if len(held) > PARTS_HELD:
                yield rows(held)
                held = {}
        if held:
            yield rows(held)

    counted = judged.select("part", "fails", "labels").mapInArrow(run, "part string, " + ", ".join(f"{c} bigint" for c in names))
    total = counted.groupBy("part").agg(*(F.sum(c).alias(c) for c in names))
    return total.select("part", *(F.array(*names[j * size : (j + 1) * size]).alias(c) for j, c in enumerate(["n", *labels])))


def _shapley(k: int, f: int) -> str:
    """Removed by filter f over all orders: each set before it stands in |set|! (k - 1 - |set|)! of them."""
    terms = []
    for s in range(1 << k):
        if not s >> f & 1:
            size = s.bit_count()
            terms.append(f"{factorial(size) * factorial(k - 1 - size)} * (n[{s}] - n[{s | 1 << f}])")
    return " + ".join(terms)


def orders(counts: DataFrame, filters: str = FILTERS, lost: dict[str, str] | None = None) -> DataFrame:
    """One row for each part, order of the filters (named by a letter each) and step; lost: label column to output name."""
    k = len(filters)
    full = (1 << k) - 1
    steps = []
    for order in permutations(range(k)):
        before = 0
        for step, f in enumerate(order):
            steps.append(("".join(filters[i] for i in order), step + 1, f, before, before | 1 << f))
            before |= 1 << f
    column = lambda i: F.lit([x[i] for x in steps])
    out = counts.withColumn("shapleys", F.array(*(F.expr(_shapley(k, f)) for f in range(k)))).withColumn("failing", F.array(*(F.expr(f"n[0] - n[{1 << f}]") for f in range(k)))).withColumn("unique", F.array(*(F.expr(f"n[{full ^ 1 << f}] - n[{full}]") for f in range(k))))
    out = out.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))).alias("i"))
    out = out.select("*", F.get(column(0), F.col("i")).alias("filter_order"), F.get(column(1), F.col("i")).alias("step"), F.get(column(2), F.col("i")).alias("f"), F.get(column(3), F.col("i")).alias("was"), F.get(column(4), F.col("i")).alias("now"))
    gone = lambda c: F.get(c, F.col("was")) - F.get(c, F.col("now"))
    return out.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), F.get("n", F.col("now")).alias("kept"), gone("n").alias("removed"), (F.get("failing", F.col("f")) - gone("n")).alias("redundant"),
        F.get("unique", F.col("f")).alias("unique_fails"), *(gone(c).alias(name) for c, name in (lost or {}).items()), F.get("shapleys", F.col("f")).alias("shapley"),
    )
