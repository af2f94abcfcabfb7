"""Near-duplicate vectors by cosine: inverted lists, product codes, exact rerank.

1. Equal vectors are one class (compared whole), with a count; so copies never meet each other.
2. A bounded sample of the classes gives coarse centroids and, of the residuals, codebooks of
   SUBSPACES subspaces. Every class is indexed: it belongs to the list of its nearest centroid,
   with a code and the length of what the code leaves.
3. A class asks its own list and each list whose border is within reach. A link's second
   vector is at most r = sqrt(2 - 2 * threshold) away, and d dimensions leave r / sqrt(d) of that
   for any one direction: borders up to SPREAD times as far are crossed (never more than r, beyond
   which no link can reach). A pair is missed only if both its vectors miss the other's list,
   that is, where it differs by twice as much along the line between two centroids.
4. Lists meet their queries in cells of bounded size: blocks of members by shards of queries.
   In a cell the asymmetric distance from a query to a code, less what the code leaves, bounds the
   true distance from below; only pairs that may be within r are compared. This bound loses nothing.
5. What may be linked is compared by exact cosine in double precision.
6. A cell sends for each linked vector a number of links and the smallest vector it hangs together
   with, not pairs. Sums and components follow in Spark.

Lists over any size are split, never cut: all blocks meet all shards. Vectors of different length
are never compared; the FITTED most frequent lengths get lists, the vectors of any other length
are one list, compared exactly.

Null ids, null, empty and zero vectors, and those with null or not finite components link with
nothing; they are components of their own. Rows that repeat an id are rows of their own; rows that
repeat a vector are linked with each other. An empty table gives an empty result. Input columns
are read by name and others ignored, so no name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .exchange import cut, named
from .memory import give_back
from .quantiser import Quantiser

THRESHOLD, SPREAD = 0.95, 2.0
#: Mean members of a list, most lists of one length, members and queries that meet in a cell.
LIST, MAX_LISTS, BLOCK, SHARD = 256, 4096, 512, 1024
#: The fitting sample: rows, and bytes as double precision; lengths that are fitted.
FIT_ROWS, FIT_BYTES, FITTED = 65_536, 64 << 20, 16
#: Pairs that are compared at once, rows that are indexed at once, and their distances to lists.
PAIRS, ROWS, MARGINS = 1 << 16, 2048, 1 << 21


def vectors(df: DataFrame, key: str, column: str) -> tuple[DataFrame, str]:
    """((id, v binary) with null for vectors that link with nothing, numpy type of the components)."""
    kind = "f4" if df.schema[column].dataType.simpleString() == "array<float>" else "f8"
    values = named(column) if kind == "f4" else named(column).cast("array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            lists = batch.column(1)
            at = np.asarray(lists.offsets).astype(np.int64)
            flat = lists.values.slice(at[0], at[-1] - at[0])
            at = at - at[0]
            x = flat.to_numpy(zero_copy_only=False).astype(kind) + np.dtype(kind).type(0)  # -0 becomes 0; null components become NaN
            good = np.append(0, np.cumsum(np.isfinite(x)))[at]
            some = np.append(0, np.cumsum(x != 0))[at]
            ok = (np.diff(good) == np.diff(at)) & (np.diff(some) > 0) & lists.is_valid().to_numpy(zero_copy_only=False)
            size = np.dtype(kind).itemsize
            blobs = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(at * size), pa.py_buffer(x)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.if_else(pa.array(ok), blobs, pa.scalar(None, pa.binary()))], ["id", "v"])

    return df.select(named(key).alias("id"), values.alias("v")).mapInArrow(run, f"id {df.schema[key].dataType.simpleString()}, v binary"), kind


def unit(blobs: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(vectors in double precision, unit vectors) of equal length; the largest component is 1 first, so that no square overflows."""
    x = np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x, x / np.sqrt((x**2).sum(1, keepdims=True))


def least_hashed(rows: DataFrame, count: int, most: int) -> DataFrame:
    """The column v of the `most` rows with the least hashes, of about `count` rows. What is certainly beyond goes before the sort, which ends in one task."""
    share = (1.25 * most + 1000) / count
    if share < 1:
        rows = rows.where(F.xxhash64("v") <= int(-(2.0**63) + share * 2.0**64))
    return rows.orderBy(F.xxhash64("v"), "v").select("v").limit(most)


def fitted(classes: DataFrame, kind: str) -> dict[int, Quantiser]:
    """A quantiser for each of the most frequent lengths, from the rows with the least hashes."""
    size, models = np.dtype(kind).itemsize, {}
    lengths = classes.groupBy(F.length("v").alias("l")).count().orderBy(F.desc("count"), "l").limit(FITTED).collect()
    for row in lengths:
        d = row["l"] // size
        most = max(1, min(FIT_ROWS, FIT_BYTES // (8 * d)))
        lists = min(max(1, row["count"] // LIST), MAX_LISTS, max(1, most // 8), max(1, FIT_BYTES // (32 * d)))
        sample = least_hashed(classes.where(F.length("v") == row["l"]), row["count"], most).toArrow().column(0)
        models[row["l"]] = Quantiser.fit(unit(sample.to_pylist(), kind)[1], lists)
    return models


INDEXED = "node bigint, n bigint, v binary, length int, own int, probes array<int>, code binary, rest double"


def _indexed(models, kind: str, reach: float, spread: float):
    """Every class with its list, the other lists it asks, its code and what that leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        step = max(1, min(ROWS, MARGINS // max([1, *(len(m.centroids) for m in models.value.values())])))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                v = batch.column(2).to_pylist()
                lengths = np.array([len(x) for x in v])
                for length in np.unique(lengths).tolist():
                    some = np.flatnonzero(lengths == length)
                    u = unit([v[i] for i in some.tolist()], kind)[1]
                    model = models.value.get(length) or Quantiser.trivial(u.shape[1])
                    own, margins = model.margins(u)
                    asked = margins <= reach * min(1.0, spread / u.shape[1] ** 0.5)
                    asked[np.arange(len(u)), own] = False
                    row, probe = np.nonzero(asked)
                    probes = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=len(u)))), pa.int32()), pa.array(probe, pa.int32()))
                    codes, rest = model.encode(u, own)
                    kept = batch.take(pa.array(some))
                    yield pa.RecordBatch.from_arrays(
                        [*kept.columns, pa.array(np.full(len(u), length), pa.int32()), pa.array(own, pa.int32()), probes, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(rest)],
                        ["node", "n", "v", "length", "own", "probes", "code", "rest"],
                    )

    return run


def linked_pairs(model: Quantiser, at: int, q: np.ndarray, qx: np.ndarray, m: np.ndarray, mx: np.ndarray, codes: np.ndarray, rest: np.ndarray, threshold: float, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) places of all pairs of a cell with cosine >= threshold; q and m are unit vectors, qx and mx the vectors."""
    if model.books:
        bound = (reach + rest + 1e-3) ** 2  # codes are measured in single precision
        a, b = np.nonzero(model.distances(q, at, codes) <= bound)
    else:
        a, b = (x.ravel() for x in np.indices((len(q), len(m))))
    norm_q, norm_m = np.sqrt((qx**2).sum(1)), np.sqrt((mx**2).sum(1))
    if 16 * len(a) > len(q) * len(m):  # most are near: one product of matrices
        near = (qx @ mx.T)[a, b] / (norm_q[a] * norm_m[b]) >= threshold
    else:
        near = np.zeros(len(a), bool)
        for lo in range(0, len(a), PAIRS):
            s, t = a[lo : lo + PAIRS], b[lo : lo + PAIRS]
            near[lo : lo + PAIRS] = (qx[s] * mx[t]).sum(1) / (norm_q[s] * norm_m[t]) >= threshold
    return a[near], b[near]


def least_connected(node: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each one hangs together with by the edges (places in node)."""
    s, t = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.argsort(s, kind="stable")
    s, t = s[order], t[order]
    heads = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    out = node.copy()
    while len(s):
        new = np.minimum(out[s[heads]], np.minimum.reduceat(out[t], heads))
        if (new == out[s[heads]]).all():
            break
        out[s[heads]] = new
    return out


def _met(models, kind: str, threshold: float, reach: float):
    """(node, links, root) of the linked vectors of each cell; members (ask = 0) come before queries."""

    def cell(length: int, at: int, rows: list[tuple]) -> pa.RecordBatch | None:
        members, queries = [r for r in rows if not r[0]], [r for r in rows if r[0]]
        if not members or not queries:
            return None
        d = length // np.dtype(kind).itemsize
        model = models.value.get(length) or Quantiser.trivial(d)
        (mx, mu), (qx, qu) = unit([r[3] for r in members], kind), unit([r[3] for r in queries], kind)
        codes = np.frombuffer(b"".join(r[6] for r in members), np.uint8).reshape(len(members), -1)
        a, b = linked_pairs(model, at, qu, qx, mu, mx, codes, np.array([r[7] for r in members]), threshold, reach)
        q_node, m_node = np.array([r[1] for r in queries], np.int64), np.array([r[1] for r in members], np.int64)
        q_own = np.array([r[4] for r in queries])
        mine = q_own[a] == at
        # Within a list each pair stands twice; between lists it may be found from both sides. Each is taken once.
        keep = np.where(mine, q_node[a] < m_node[b], q_own[a] > at)
        for i in np.flatnonzero(~mine & ~keep).tolist():
            keep[i] = int(q_own[a[i]]) not in members[b[i]][5]
        a, b = a[keep], b[keep]
        if not len(a):
            return None
        node, place = np.unique(np.concatenate([q_node, m_node]), return_inverse=True)
        left, right = place[a], place[len(queries) + b]
        q_n, m_n = np.array([r[2] for r in queries], np.float64), np.array([r[2] for r in members], np.float64)
        links = np.bincount(left, m_n[b], len(node)) + np.bincount(right, q_n[a], len(node))
        root = least_connected(node, left, right)
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some].astype(np.int64)), pa.array(root[some])], ["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        place, rows = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(batch.num_columns)]
            for length, at, block, shard, *row in zip(*columns, strict=True):
                if (length, at, block, shard) != place:
                    if rows and (out := cell(*place[:2], rows)) is not None:
                        yield out
                    place, rows = (length, at, block, shard), []
                rows.append(tuple(row))
        if rows and (out := cell(*place[:2], rows)) is not None:
            yield out

    return run


def _cells(indexed: DataFrame) -> DataFrame:
    """Members and queries of each list, dealt out to blocks and shards; a member goes to every shard, a query to every block."""
    asking = indexed.withColumn("list", F.explode(F.concat(F.array("own"), "probes")))
    members = indexed.groupBy("length", F.col("own").alias("list")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    shards = asking.groupBy("length", "list").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("shards"))
    sizes = cut(members.join(shards, ["length", "list"]), "lists")
    dealt = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = indexed.withColumn("list", F.col("own")).join(sizes, ["length", "list"]).withColumns({"block": dealt(1, "blocks"), "shard": all_of("shards"), "ask": F.lit(0)})
    asked = asking.join(sizes, ["length", "list"]).withColumns({"shard": dealt(2, "shards"), "block": all_of("blocks"), "ask": F.lit(1)})
    columns = ["length", "list", "block", "shard", "ask", "node", "n", "v", "own"]
    # What only one side needs stays behind.
    own = own.select(*columns, "probes", "code", "rest")
    asked = asked.select(*columns, F.lit(None).cast("array<int>").alias("probes"), F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("rest"))
    place = ["length", "list", "block", "shard"]
    return own.unionByName(asked).repartition(*place).sortWithinPartitions(*place, "ask")


def cosine_links(df: DataFrame, key: str = "vec_id", column: str = "embedding", threshold: float = THRESHOLD, spread: float = SPREAD) -> DataFrame:
    """(key, n_links, component_id, kept) for each row; threshold is above 0."""
    found, kind = vectors(df, key, column)
    reach = float(np.sqrt(max(2 - 2 * threshold, 0.0)))
    marks = lambda: (F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    classes = found.where("id IS NOT NULL AND v IS NOT NULL").groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("node"), "rep", "n", "v"), "vectors")
    models = df.sparkSession.sparkContext.broadcast(fitted(classes, kind))
    indexed = cut(classes.select("node", "n", "v").mapInArrow(_indexed(models, kind, reach, spread), INDEXED), "indexed")
    met = cut(_cells(indexed).mapInArrow(_met(models, kind, threshold, reach), "node bigint, links bigint, root bigint"), "met")
    joined = components(met.where("node <> root"), "node", "root")
    reps = classes.select("node", "rep", "n", *marks())
    linked = cut(reps.join(joined, "node"), "linked")
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    least = linked.join(least, "component").select("node", "least")
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    judged = reps.join(links, "node", "left").join(least, "node", "left").select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    rows = found.select("id", *(F.when(F.col("id").isNotNull() & F.col("v").isNotNull(), h).alias(name) for h, name in zip(marks(), ("h1", "h2"), strict=True)))
    out = rows.join(judged, ["h1", "h2"], "left").select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
