"""N-gram Jaccard join by a token-group matrix.

Documents are sets of 5-word shingles, linked when 100 * shared >= 75 * united.

1. Equal sets are one class, named by a 64-bit digest of its tokens.
2. Tokens go to buckets by their hash, packed, and come back to the documents with a
   frequency class, those that stand in one document alone left out. A document of
   which less than 75 % comes back is linked with nothing. What remains is exact: for
   any link, the shared part lies within what came back.
3. Documents are partitioned into groups: those that share a least token under one of
   GROUP_KEYS hash orders are compared with a few leaders, and join the group of a
   leader they are linked with. Members of one group are connected. Leaders are found
   in each batch first, then for each key and salt, then, of salted keys, among the
   salts' leaders; so no task meets more of a hot key than leaders of batches. Leaders
   that share a follower make one group.
4. The token-group matrix has a cell for each token of a group's union of prefix tokens
   (rarest first; a link must share one), with the sizes of the members behind it. A
   query document meets the groups in whose columns its own prefix tokens stand, where
   sizes allow a link; groups it is in already are not met.
5. Such a group is opened in chunks of bounded size. A chunk's token union bounds what
   any member can share with the query; only chunks that reach 75 % of the query's
   size are compared member by member.
6. Links of groups in step 5 give the components. Any link between two documents is either
   inside a group or found in step 5, so none is lost; copies and groups are never
   expanded into pairs.

Null or wordless text has an empty set and is linked with nothing. Fewer than five words
are one shingle. A null id is left out of the search and stays alone, with a null
component. Rows that repeat an id are judged row by row, each by its own text: one may
have another component than the other. An empty table gives an empty result. Keys may be
of any type that Spark can order; other columns are not touched, whatever their names.

Tokens and classes are told apart by 64-bit hashes, equal classes by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .exchange import PACKED, buckets, cut, exchange, gather, named, pack, rows, split, unpack
from .fingerprints import shingle_rows
from .textcore import U64, as_bytes, bucket_of, hash_bucket, mix, ranges, slices

PERCENT = 75
GROUP_KEYS, LEADERS, CHUNK = 2, 32, 256
#: Documents of one key in a batch from which on its leaders are dealt out by salt.
SALTED = 8
#: Tokens that a task packs at once.
SENT = 1 << 20
TOKENS, HEADS = 1, 0
_TOKEN_TYPES = ("i8", "i4", "u8")
_BACK_TYPES = ("i8", "u8", "u1")
_HEAD_TYPES = ("i8", "i4")
_CELL_TYPES = ("u8", "i8", "i8", "i4", "i4")
_SEEDS = mix(np.arange(1, GROUP_KEYS + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))


def sets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row in ascending order, and rows + 1 places."""
    hashes, places = shingle_rows(raw, offsets)
    row = np.repeat(np.arange(len(places) - 1), np.diff(places))
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], np.append(0, np.cumsum(np.bincount(row[new], minlength=len(places) - 1)))


def set_marks(hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set, equal for equal sets whatever the order; 0 for empty sets."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.append(U64(0), np.cumsum(mix(hashes ^ U64(salt))))
        out.append((sums[places[1:]] - sums[places[:-1]]).view(np.int64))
    return out[0], out[1]


def linked(shared, a, b):
    return 100 * shared >= PERCENT * (a + b - shared)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = as_bytes(batch.column(2))
        for lo, hi in slices(offsets):
            hashes, places = sets(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            a, b = set_marks(hashes, places)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(places)), pa.array(a), pa.array(b)], ["id", "t", "n", "a", "b"])


def _tokens(n: int):
    """Each batch's distinct sets, packed by token bucket: class, number of tokens, tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = as_bytes(batch.column(0))
            found, size = [], 0
            for lo, hi in slices(offsets):
                hashes, places = sets(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                found.append((hashes, np.diff(places), set_marks(hashes, places)[0]))
                size += len(hashes)
                if size >= SENT:
                    yield from sent(found)
                    found, size = [], 0
            if found:
                yield from sent(found)

    def sent(found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        hashes, counts, a = (np.concatenate(c) for c in zip(*found, strict=True))
        keep = np.zeros(len(a), bool)
        keep[np.unique(a, return_index=True)[1]] = True  # of equal sets one speaks for all
        yield from _runs(hashes[np.repeat(keep, counts)], np.repeat(a[keep], counts[keep]), n)

    return run


def _runs(hashes: np.ndarray, doc: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    bucket = hash_bucket(hashes, n)
    order = np.argsort(bucket, kind="stable")
    bucket, doc, hashes = bucket[order], doc[order], hashes[order]
    new = np.ones(len(bucket), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (doc[1:] != doc[:-1])
    heads = np.flatnonzero(new)
    counts = np.diff(np.append(heads, len(bucket))).astype(np.int32)
    present = np.unique(bucket)
    token_edges = np.append(np.searchsorted(bucket, present), len(bucket)).tolist()
    run_edges = np.append(np.searchsorted(bucket[heads], present), len(heads)).tolist()
    parts, size = [], 0
    for i, b in enumerate(present.tolist()):
        t, r = slice(token_edges[i], token_edges[i + 1]), slice(run_edges[i], run_edges[i + 1])
        parts.append((b, TOKENS, pack((doc[heads[r]], counts[r], hashes[t]))))
        size += len(parts[-1][2])
        if size > 8 << 20:
            yield rows(parts)
            parts, size = [], 0
    if parts:
        yield rows(parts)


def _frequencies(n: int):
    """Tokens of a bucket back to their classes with a frequency grade, without those of a single class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in gather(batches):
            doc, counts, token = (np.concatenate(c) for c in zip(*(unpack(blob, _TOKEN_TYPES) for _, blob in held), strict=True))
            doc = np.repeat(doc, counts)
            order = np.argsort(token, kind="stable")
            token, doc = token[order], doc[order]
            again = np.zeros(len(token), bool)
            again[1:] = token[1:] == token[:-1]
            some = again.copy()
            some[:-1] |= again[1:]
            token, doc = token[some], doc[some]
            # Equal sets of several batches have sent their tokens more than once.
            order = np.lexsort((doc, token))
            token, doc = token[order], doc[order]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
            token, doc = token[new], doc[new]
            frequency = _frequency(token)
            keep = frequency > 1
            if not keep.any():
                continue
            token, doc = token[keep], doc[keep]
            kind = np.ceil(np.log2(frequency[keep])).astype(np.uint8)
            yield from split(bucket_of(doc, n), TOKENS, (doc, token, kind))

    return run


def _frequency(token: np.ndarray) -> np.ndarray:
    """How often each element of an ascending array stands in it."""
    if not len(token):
        return np.zeros(0, np.int64)
    edges = np.append(np.flatnonzero(np.append(True, token[1:] != token[:-1])), len(token))
    return np.repeat(np.diff(edges), np.diff(edges))


def _headed(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, size = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int32)
            if len(ids):
                yield from split(bucket_of(ids, n), HEADS, (ids, size))

    return run


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n, tokens, prefix): tokens ascending; prefix has the rarest that a link must share one of."""
    for _, held in gather(batches):
        heads = [unpack(b, _HEAD_TYPES) for k, b in held if k == HEADS]
        tokens = [unpack(b, _BACK_TYPES) for k, b in held if k == TOKENS]
        if not heads or not tokens:
            continue
        ids, size = (np.concatenate(c) for c in zip(*heads, strict=True))
        order = np.argsort(ids)
        ids, size = ids[order], size[order].astype(np.int64)
        doc, token, kind = (np.concatenate(c) for c in zip(*tokens, strict=True))
        # Ids without a head stand for their class no longer.
        at = np.minimum(np.searchsorted(ids, doc), len(ids) - 1)
        mine = ids[at] == doc
        at, token, kind = at[mine], token[mine], kind[mine]
        back = np.bincount(at, minlength=len(ids))
        enough = 100 * back >= PERCENT * size
        hold = enough[at]
        at, token, kind = at[hold], token[hold], kind[hold]
        order = np.lexsort((token, kind, at))
        at, token = at[order], token[order]
        own = np.flatnonzero(enough & (back > 0))
        starts = np.searchsorted(at, own)
        out: list[tuple] = []
        held_bytes = 0
        for d, s in zip(own.tolist(), starts.tolist(), strict=True):
            n, c = int(size[d]), int(back[d])
            mine = token[s : s + c]
            length = n - -(-PERCENT * n // 100) + 1 - (n - c)
            if length > 0:
                out.append((int(ids[d]), n, np.sort(mine).tobytes(), mine[:length].tobytes()))
                held_bytes += 16 * c
            if held_bytes > 8 << 20:
                yield _survivor_rows(out)
                out, held_bytes = [], 0
        if out:
            yield _survivor_rows(out)


def _survivor_rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["id", "n", "tokens", "prefix"])


def shared_size(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two ascending arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(b):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


#: A row of the search for leaders: a document that leads so far, or a link to its leader (without tokens).
LED = "key bigint, salt int, id bigint, n bigint, tokens binary, leader bigint"
_LED = pa.schema([("key", pa.int64()), ("salt", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary()), ("leader", pa.int64())])


def _led_rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 6, _LED.types, strict=True)], schema=_LED)


def _follow(i: int, n: int, tokens: np.ndarray, leaders: list[tuple]) -> int | None:
    """The leader that a document is linked with, if any."""
    for leader, size, own in leaders:
        if PERCENT * size <= 100 * n and PERCENT * n <= 100 * size and linked(shared_size(tokens, own), n, size):
            return leader
    return None


def _leaders_here(salts: int):
    """Each batch's own leaders of each key, and links of the rest to them. Leaders of keys that are frequent here are dealt out by salt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt = 1 + TaskContext.get().partitionId() % salts
        for whole in batches:
            for lo, hi in slices(as_bytes(whole.column(2))[1], 4 << 20):  # views of the batch, so that little is held beside it
                batch = whole.slice(lo, hi - lo)
                raw, at = as_bytes(batch.column(2))
                ids, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                sets_ = [raw[a:b].view(np.uint64) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                order = sorted(range(len(ids)), key=ids.__getitem__)
                for seed in _SEEDS:
                    by: dict[int, list[int]] = {}
                    for r in order:
                        by.setdefault(int(mix(sets_[r] ^ seed).min().view(np.int64)), []).append(r)
                    links, lead, keys, dealt = [], [], [], []
                    for key, own in by.items():
                        leaders: list[tuple] = []
                        for r in own:
                            leader = _follow(ids[r], sizes[r], sets_[r], leaders)
                            if leader is not None:
                                links.append((ids[r], 0, ids[r], sizes[r], None, leader))
                            elif len(leaders) < LEADERS:
                                leaders.append((ids[r], sizes[r], sets_[r]))
                                lead.append(r)
                                keys.append(key)
                                dealt.append(salt if len(own) >= SALTED else 0)
                    yield _led_rows(links)
                    some = batch.take(pa.array(lead, pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(dealt, pa.int32()), *some.columns, pa.nulls(len(lead), pa.int64())], schema=_LED)

    return run


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each document to one of the first few leaders of its key and salt; leaders of salted keys go on, links pass."""
    place, leaders = None, []
    for batch in batches:
        out: list[tuple] = []
        for key, salt, i, n, t, leader in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
            if leader is not None:
                out.append((key, salt, i, n, None, leader))
                continue
            if (key, salt) != place:
                place, leaders = (key, salt), []
            tokens = np.frombuffer(t, np.uint64)
            leader = _follow(i, n, tokens, leaders)
            if leader is not None:
                out.append((key, salt, i, n, None, leader))
            elif len(leaders) < LEADERS:
                leaders.append((i, n, tokens))
                if salt:
                    out.append((key, 0, i, n, t, None))
        yield _led_rows(out)


def _led_links(survivors: DataFrame, n: int) -> DataFrame:
    """(a, b): links of documents to the leaders of their groups; b is the smaller one."""
    together = lambda df: df.repartition("key", "salt").sortWithinPartitions("key", "salt", "id").mapInArrow(_led, LED)
    first = cut(together(survivors.select("id", "n", "tokens").mapInArrow(_leaders_here(1 + int(n**0.5)), LED)), "led")
    found, salted = first.where("leader IS NOT NULL"), first.where("leader IS NULL")
    if not salted.isEmpty():
        found = found.unionByName(cut(together(salted), "led").where("leader IS NOT NULL"))
    return found.select(F.col("id").alias("a"), F.col("leader").alias("b"))


def _cells(n: int):
    """Prefix tokens with document, group, size and what stands behind the token in the document's order, packed by token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, group, size = (batch.column(c).to_numpy() for c in (0, 1, 2))
            prefixes = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column(3)]
            if not prefixes:
                continue
            counts = np.array([len(p) for p in prefixes])
            token = np.concatenate(prefixes)
            held = np.array([len(x.as_py()) // 8 for x in batch.column(4)])  # tokens of this document alone come first and are not held
            rest = np.repeat(held, counts) - ranges(np.zeros(len(counts), np.int64), counts)
            yield from split(hash_bucket(token, n), TOKENS, (token, np.repeat(ids, counts), np.repeat(group, counts), np.repeat(size, counts).astype(np.int32), rest.astype(np.int32)))

    return run


def meetings(token: np.ndarray, doc: np.ndarray, group: np.ndarray, size: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, group) for each document and each group of a smaller number in a column of the query's tokens, where a link is possible.

    Sizes must allow it, and so must places: if the token is the first that two sets share,
    they share at most what stands from it on in either order (rest), and a link needs
    75 / 175 of both sizes together. A pair that fails at its first common token fails at all.
    """
    order = np.lexsort((doc, group, token))
    token, doc, group, size, rest = token[order], doc[order], group[order], size[order].astype(np.int64), rest[order].astype(np.int64)
    new_token = np.ones(len(token), bool)
    new_token[1:] = token[1:] != token[:-1]
    new_cell = new_token.copy()
    new_cell[1:] |= group[1:] != group[:-1]
    cells = np.flatnonzero(new_cell)
    cell = np.cumsum(new_cell) - 1
    smallest, largest = np.minimum.reduceat(size, cells), np.maximum.reduceat(size, cells)
    most_rest = np.maximum.reduceat(rest, cells)
    first_cell = cell[np.maximum.accumulate(np.where(new_token, np.arange(len(token)), 0))]
    before = cell - first_cell
    query, met = [], []
    asks = np.flatnonzero(before)
    edges = np.cumsum(before[asks])
    at = 0
    while at < len(asks):  # in stretches, so that a frequent token's meetings stay bounded in memory
        end = max(at + 1, int(np.searchsorted(edges, (edges[at - 1] if at else 0) + (1 << 21), "right")))
        some = asks[at:end]
        q = np.repeat(some, before[some])
        c = ranges(first_cell[some], before[some])
        fits = (PERCENT * smallest[c] <= 100 * size[q]) & (100 * largest[c] >= PERCENT * size[q])
        fits &= (100 + PERCENT) * np.minimum(rest[q], most_rest[c]) >= PERCENT * (size[q] + smallest[c])
        pair = np.unique(np.stack([doc[q[fits]], group[cells[c[fits]]]]), axis=1)
        query.append(pair[0])
        met.append(pair[1])
        at = end
    if not query:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pair = np.unique(np.stack([np.concatenate(query), np.concatenate(met)]), axis=1)
    return pair[0], pair[1]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, held in gather(batches):
        q, g = meetings(*(np.concatenate(c) for c in zip(*(unpack(b, _CELL_TYPES) for _, b in held), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(g)], ["id", "met"])


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): queries that are linked with a member of a chunk, and its group; members (ask = 0) come before queries."""
    place, members, chunk = None, [], None
    for batch in batches:
        a, b = [], []
        for group, part, ask, i, n, t in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):  # part: a chunk's shard
            if (group, part) != place:
                place, members, chunk = (group, part), [], None
            tokens = np.frombuffer(t, np.uint64)
            if not ask:
                members.append((i, n, tokens))
                continue
            if not members:
                continue
            if chunk is None:
                flat = np.concatenate([m[2] for m in members])
                lengths = np.array([len(m[2]) for m in members])
                chunk = (np.array([m[1] for m in members]), flat, np.cumsum(lengths) - lengths, np.unique(flat))
            sizes, flat, starts, union = chunk
            if 100 * shared_size(tokens, union) < PERCENT * n:
                continue
            at = np.searchsorted(tokens, flat)
            at[at == len(tokens)] = 0
            shared = np.add.reduceat((tokens[at] == flat).astype(np.int64), starts)
            if linked(shared, sizes, n).any():
                a.append(i)
                b.append(group)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def connected(survivors: DataFrame, n: int) -> DataFrame:
    """(node, component) of all sets that are linked with another."""
    group = cut(components(_led_links(survivors, n), "a", "b"), "led-groups").select(F.col("node").alias("id"), F.col("component").alias("grp"))
    grouped = cut(survivors.join(group, "id", "left").select("id", F.coalesce("grp", "id").alias("grp"), "n", "tokens", "prefix"), "groups")
    cells = exchange(grouped.select("id", "grp", "n", "prefix", "tokens").mapInArrow(_cells(n), PACKED), n)
    met = cut(cells.mapInArrow(_meet, "id bigint, met bigint").distinct(), "met")
    opened = met.select(F.col("met").alias("grp")).distinct()
    sizes = grouped.groupBy("grp").agg(F.count(F.lit(1)).alias("members")).join(opened, "grp", "left_semi").select("grp", F.ceil(F.col("members") / CHUNK).cast("int").alias("chunks"))
    # A chunk meets its queries in shards of bounded size; the chunk goes to each shard.
    asks = met.groupBy(F.col("met").alias("grp")).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("shards"))
    sizes = cut(sizes.join(asks, "grp"), "chunks")
    member = grouped.join(sizes, "grp").select("grp", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(0).alias("ask"), "id", "n", "tokens")
    query = met.join(sizes.withColumnRenamed("grp", "met"), "met").join(grouped.select("id", "n", "tokens"), "id")
    query = query.select(F.col("met").alias("grp"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("part"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("shards")).cast("int").alias("shard"), F.lit(1).alias("ask"), "id", "n", "tokens")
    second = member.unionByName(query).repartition("grp", "part", "shard").sortWithinPartitions("grp", "part", "shard", "ask", "id").select("grp", F.struct("part", "shard").alias("part"), "ask", "id", "n", "tokens").mapInArrow(_open, "a bigint, b bigint")
    # Queries by their groups: few edges are left, between groups.
    between = second.join(grouped.select(F.col("id").alias("a"), "grp"), "a").select(F.col("grp").alias("a"), "b").distinct()
    joined = components(between, "a", "b")
    inside = group.join(joined.withColumnRenamed("node", "grp"), "grp", "left").select(F.col("id").alias("node"), F.coalesce("component", "grp").alias("component"))
    alone = joined.join(group.select(F.col("id").alias("node")), "node", "left_anti")
    return inside.unionByName(alone)


def _judged(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, t, n, least): each row's key, 64-bit text hash and set size, and the smallest (id, t) of its component."""
    base = docs.select(named(key).alias("id"), F.xxhash64(named(text)).alias("t"), named(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    n = 2 * buckets(docs)  # a bucket's tokens are sorted in several arrays at once
    heads = cut(base.mapInArrow(_sizes, f"id {kind}, t bigint, n bigint, a bigint, b bigint"), "sizes")
    held = (F.col("n") > 0) & F.col("id").isNotNull()
    classes = heads.where(held).groupBy("a", "b").agg(F.min(F.struct("id", "t")).alias("rep"), F.max("n").alias("n"))
    tokens = exchange(base.where("id IS NOT NULL").select("text").mapInArrow(_tokens(n), PACKED), n).mapInArrow(_frequencies(n), PACKED)
    reps = classes.select(F.col("a").alias("id"), "n").mapInArrow(_headed(n), PACKED)
    survivors = cut(exchange(tokens.unionByName(reps), n).mapInArrow(_survivors, "id bigint, n bigint, tokens binary, prefix binary"), "survivors")
    found = connected(survivors, n).withColumnRenamed("node", "a")
    # Only linked classes, which are few, are grouped by component; the others stand for themselves.
    linked_ = cut(classes.select("a", "rep").join(found, "a"), "linked")
    least = linked_.groupBy("component").agg(F.min("rep").alias("least"))
    least = linked_.join(least, "component").select("a", "least")
    standing = classes.select("a", "b", "rep").join(least, "a", "left").select("a", "b", F.coalesce("least", "rep").alias("least"))
    out = heads.join(standing, ["a", "b"], "left")
    return out.select("id", "t", "n", F.when(held, F.col("least")).alias("least"))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) for each row."""
    return _judged(docs, key, text).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("least").isNotNull(), F.col("least.id")).otherwise(F.col("id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with all columns, of each component the one with the smallest id.

    Null ids stay, and so do texts without words. Rows that repeat an id are told apart by
    their texts; of rows that repeat both the id and the text one stays, whatever else they hold.
    """
    judged = _judged(docs, key, text)
    marks = [F.col("id").alias("__weft_id"), F.col("t").alias("__weft_t")]
    gone = judged.where(F.struct("id", "t") != F.col("least")).select(*marks).distinct()
    same = lambda: (named(key) == F.col("__weft_id")) & (F.xxhash64(named(text)) == F.col("__weft_t"))
    left = docs.join(gone, same(), "left_anti")
    # Only rows that repeat are gathered by their text.
    again = cut(judged.select("id", "t").groupBy("id", "t").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*marks), "again")
    if again.isEmpty():
        return left
    return left.join(again, same(), "left_anti").unionByName(left.join(again, same(), "left_semi").dropDuplicates([key, text]))
