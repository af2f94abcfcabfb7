"""Document fingerprints: MinHash over word shingles, and near-duplicate classes by banding.

A text's shingles are its 5-word sequences in lower case (A-Z), or the whole sequence of
a text with fewer words. Each of PERMUTATIONS universal hash functions (a * x + b modulo
2**64, a odd, high bits kept) maps the shingles, and the fingerprint keeps each minimum's
upper 32 bits as hexadecimal. Likeness is the share of equal places, an unbiased estimate
of the Jaccard likeness with a standard error under 0.045.

Null and empty texts have no shingles; they share one fingerprint of all ones and are
alike (1.0) to each other. Equal texts have equal fingerprints. Very long texts are
hashed slice by slice.

Rows with a null id come first of all in ascending order, as Spark sorts. Rows that
repeat an id are neighbours in the order of their texts. An empty table gives an empty
result; a single document is its own next one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .exchange import buckets, cut, integer_key, named
from .textcore import U64, as_bytes, hash_words, ngrams, slices, spans

PERMUTATIONS, SHINGLE, THRESHOLD = 128, 5, 0.75
BANDS = 32
#: Most ranges of ids that are dealt out (at most as many bounds reach the driver); most distinct fingerprints of a band bucket that are compared pair by pair.
RANGES, BUCKET = 20_000, 64
_RNG = np.random.Generator(np.random.PCG64(77))
_A = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) << U64(1) | U64(1)
_B = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) << U64(1)
_NONE = U64(2**64 - 1)
#: Shingles taken through all permutations at once, so that they stay in the processor's cache.
BLOCK = 1 << 14


def minima(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(rows, PERMUTATIONS) minima of a * x + b; starts has rows + 1 ascending places; rows without shingles get all ones."""
    rows = len(starts) - 1
    out = np.full((PERMUTATIONS, rows), _NONE, np.uint64)
    y = np.empty(BLOCK, np.uint64)
    for at in range(0, len(shingles), BLOCK):
        x = shingles[at : at + BLOCK]
        lo = int(np.searchsorted(starts, at, "right")) - 1
        hi = int(np.searchsorted(starts, at + len(x), "left"))
        cuts = np.maximum(starts[lo:hi] - at, 0)
        # reduceat gives rubbish for empty rows: keep those with shingles here.
        ends = np.minimum(starts[lo + 1 : hi + 1] - at, len(x))
        full = np.flatnonzero(ends > cuts)
        cuts, own = cuts[full], lo + full
        z = y[: len(x)]
        for k in range(PERMUTATIONS):
            np.multiply(x, _A[k], out=z)
            z += _B[k]
            least = np.minimum.reduceat(z, cuts)
            out[k, own] = np.minimum(out[k, own], least)
    return out.T


def shingle_rows(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows, one after another, and rows + 1 places where each row's begin."""
    start, end, first = spans(raw, offsets)
    words = hash_words(raw, start, end, lower=True)
    n = np.diff(first)
    grams = ngrams(words, SHINGLE)
    counts = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(np.int64))
    places = np.append(0, np.cumsum(counts))
    out = np.empty(int(places[-1]), np.uint64)
    inside = np.ones(len(grams), bool)
    for back in range(1, SHINGLE):  # windows that would run into the next row
        at = first[1:-1] - back
        at = at[(at >= 0) & (at < len(grams))]
        inside[at] = False
    long = np.repeat(n >= SHINGLE, counts)
    keep = grams[inside]
    out[long] = keep[: int(long.sum())] if len(keep) == int(long.sum()) else _windows(grams, first, n)
    for r in np.flatnonzero((n > 0) & (n < SHINGLE)).tolist():
        out[places[r]] = ngrams(words[first[r] : first[r + 1]], int(n[r]))[0] ^ U64(int(n[r]))
    return out, places


def _windows(grams: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    counts = np.maximum(n - SHINGLE + 1, 0)
    begin = np.cumsum(counts) - counts
    return grams[np.arange(int(counts.sum())) + np.repeat(first[:-1] - begin, counts)]


def signatures(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, PERMUTATIONS) unsigned 32-bit fingerprints."""
    out = np.empty((len(offsets) - 1, PERMUTATIONS), np.uint32)
    for lo, hi in slices(offsets):
        shingles, starts = shingle_rows(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        out[lo:hi] = (minima(shingles, starts) >> U64(32)).astype(np.uint32)
    return out


def as_text(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal places, row by row."""
    return (a == b).mean(axis=-1)


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint binary): PERMUTATIONS big-endian 32-bit minima."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = signatures(*as_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.astype(">u4").tobytes() for s in found], pa.binary())], [batch.schema.names[0], "fingerprint"])

    return docs.select(named(key), named(text)).mapInArrow(run, f"`{key}` {kind}, fingerprint binary")


# --- a document and the next one ------------------------------------------------------


def _dealt(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(part, again, id, text): ranges of ids, each in one task in descending order, with the range's next document (again) at its end.

    The driver sees one pair of ids for each range, never one for each document.
    """
    parts = min(buckets(docs), RANGES)
    ids = docs.select(named(key).cast("long").alias("id"))
    got = ids.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)] if parts > 1 else [0.5], 10 * RANGES).alias("q")).first()["q"] or []
    bounds = sorted(set(got))

    def part_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(bounds, np.int64)
        for batch in batches:
            column = batch.column(0)
            part = np.searchsorted(edges, column.fill_null(0).to_numpy(), "right").astype(np.int32)
            part[column.is_null().to_numpy(zero_copy_only=False)] = 0
            yield pa.RecordBatch.from_arrays([pa.array(part), *batch.columns], ["part", *batch.schema.names])

    rows = docs.select(named(key).cast("long").alias("id"), named(text).alias("text"))
    # The largest document of each range closes the range above it; the largest of all closes the lowest.
    tops = rows.select("id").mapInArrow(part_of, "part int, id long").groupBy("part").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n")).collect()
    tops = sorted((r["part"], r["top"]) for r in tops)
    closes = {top: tops[(i + 1) % len(tops)][0] for i, (_, top) in enumerate(tops)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array([t for t in closes if t is not None], pa.int64())
        for batch in part_of(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.zeros(batch.num_rows, np.int32)), batch.column(1), batch.column(2)], ["part", "again", "id", "text"])
            hit = pa.compute.is_in(batch.column(1), wanted)
            if None in closes:
                hit = pa.compute.or_(hit, pa.compute.is_null(batch.column(1)))
            again = batch.filter(hit)
            if again.num_rows:
                to = pa.array([closes[i] for i in again.column(1).to_pylist()], pa.int32())
                yield pa.RecordBatch.from_arrays([to, pa.array(np.ones(again.num_rows, np.int32)), again.column(1), again.column(2)], ["part", "again", "id", "text"])

    dealt = rows.mapInArrow(deal, "part int, again int, id long, text string")
    dealt = dealt.repartitionById(len(bounds) + 1, dealt["part"])
    return dealt.sortWithinPartitions("part", "again", F.col("id").desc(), F.col("text").desc())


OUT = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document in descending order of ids: its fingerprint, that of its edited text, and their likeness, also to the next document.

    Edited: the last third of the code points replaced by as many from the beginning of the next document.
    """
    kind = integer_key(docs, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, closed = None, None, False
        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), (x or "" for x in batch.column(3).to_pylist()), strict=True))
            pairs: list[tuple] = []
            size = 0
            for row in rows:
                if row[0] != part:
                    part, held, closed = row[0], None, False
                # Of several rows that share the closing id, the first in order is the next document.
                if held is not None and not closed:
                    pairs.append((held[2], held[3], row[3]))
                    size += len(held[3])
                closed = closed or row[1] == 1
                held = row
                if size > 4 << 20:
                    yield answer(pairs)
                    pairs, size = [], 0
            if pairs:
                yield answer(pairs)

    def answer(pairs: list[tuple]) -> pa.RecordBatch:
        own = [p[1] for p in pairs]
        edited = [t[: len(t) - len(t) // 3] + following[: len(t) // 3] for _, t, following in pairs]
        # Each text's fingerprint serves as its own and as the next one's of the text before it.
        chain = [*own, pairs[-1][2]]
        linked = all(pairs[i][2] is pairs[i + 1][1] for i in range(len(pairs) - 1))
        if not linked:
            chain = [*own, *(p[2] for p in pairs)]
        a = signatures(*as_bytes(pa.array(chain, pa.large_string())))
        n = len(pairs)
        following = a[1 : n + 1] if linked else a[n:]
        a = a[:n]
        e = signatures(*as_bytes(pa.array(edited, pa.large_string())))
        columns = [
            pa.array([p[0] for p in pairs], pa.int64()),
            pa.array([len(t) for t in own], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array([as_text(s) for s in a]),
            pa.array([as_text(s) for s in e]),
            pa.array(likeness(a, e)),
            pa.array(likeness(a, following)),
        ]
        return pa.RecordBatch.from_arrays(columns, [key, *(c.split()[0] for c in OUT.split(", "))])

    return _dealt(docs, key, text).mapInArrow(run, f"`{key}` bigint, {OUT}").withColumn(key, named(key).cast(kind))


# --- near-duplicate classes -----------------------------------------------------------


def _jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = (np.unique(shingle_rows(*as_bytes(pa.array([t or ""])))[0]) for t in (a, b))
            shared = len(np.intersect1d(x, y, assume_unique=True))
            out.append(shared / max(1, len(x) + len(y) - shared))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["a", "b", "jaccard"])


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, n_links) of each document: classes by bands of the fingerprint, every link verified by the shingles' Jaccard likeness.

    Documents of one fingerprint are one class at once. Of the others, all pairs that share
    a band bucket of at most BUCKET fingerprints are verified, each once. What stands in a
    larger bucket goes, whole, through the token-group search of jaccard_groups, which
    finds every link without bands and without pairing all; it needs the threshold 0.75.
    A link outside such buckets is found if any band agrees. n_links counts, for the
    class's representative, the verified pairs and tree links that it stands in.
    """
    kind = integer_key(docs, key)
    base = docs.select(named(key).cast("long").alias("id"), named(text).alias("text"))
    prints = fingerprint_documents(base, "id", "text")
    reps = prints.where("id IS NOT NULL").groupBy("fingerprint").agg(F.min("id").alias("rep"))
    width = 4 * PERMUTATIONS // bands
    parts = F.array(*[F.xxhash64(F.lit(b), F.substring("fingerprint", b * width + 1, width)) for b in range(bands)])
    empty = F.lit(b"\xff" * (4 * PERMUTATIONS))
    banded = reps.where(F.col("fingerprint") != empty).select("rep", F.explode(parts).alias("band"))
    full = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    small = banded.join(full.where(F.col("n").between(2, BUCKET)).select("band"), "band", "left_semi")
    hot = cut(banded.join(full.where(F.col("n") > BUCKET).select("band"), "band", "left_semi").select("rep").distinct(), "hot")
    # Both sides of a pair lie in one small bucket, gathered as an array of at most BUCKET ids.
    members = small.groupBy("band").agg(F.array_sort(F.collect_set("rep")).alias("m"))
    pairs = members.select("m", F.posexplode("m").alias("i", "lead")).select("lead", F.explode(F.slice("m", F.col("i") + 2, BUCKET)).alias("rep")).distinct()
    # The text of the fingerprint that an id stands for, of the least text hash if rows repeat the id.
    own = base.where("id IS NOT NULL").groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    joined = pairs.join(own.withColumnRenamed("id", "rep"), "rep").join(own.select(F.col("id").alias("lead"), F.col("text").alias("other")), "lead").select("rep", "lead", "text", "other")
    links = joined.mapInArrow(_jaccard, "a bigint, b bigint, jaccard double").where(F.col("jaccard") >= threshold)
    links = links.select("a", "b")
    if not hot.isEmpty():
        if threshold != THRESHOLD:
            raise ValueError("buckets this large need the exact search, whose threshold is 0.75")
        from .jaccard_groups import jaccard_components

        exact = jaccard_components(own.join(hot.withColumnRenamed("rep", "id"), "id", "left_semi"), "id", "text")
        links = links.unionByName(exact.where("id <> component_id").select(F.col("id").alias("a"), F.col("component_id").alias("b"))).distinct()
    links = cut(links, "bands")
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    found = components(links, "a", "b").withColumnRenamed("node", "rep")
    classed = reps.join(found, "rep", "left").join(degree, "rep", "left").select("fingerprint", F.coalesce("component", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    out = prints.join(classed, "fingerprint", "left")
    # Texts without shingles are alike but no copies of each other's words: each stays alone.
    alone = (F.col("fingerprint") == empty) | F.col("id").isNull()
    return out.select(F.col("id").cast(kind).alias(key), F.when(alone, F.col("id")).otherwise(F.col("class_id")).cast(kind).alias("class_id"), F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"))
