"""Language-model scoring with Brown class bigrams.

P(text) is the product over its tokens of P(class | class before) * P(word | class).

Counting: every training word is counted exactly, in buckets of its 64-bit hash, packed;
the counts stay distributed as a table of vocabulary slices. The TOP most frequent words
are also broadcast, so that common words are looked up where they stand and only rarer
ones travel; that changes where a word is looked up, and no count.

Classes: the UNITS most frequent words, the end of text, and SHAPES groups of all other
words by length and last character are the units of a first exchange clustering. Their
bigram counts come from all training tokens and have at most (UNITS + SHAPES + 1)**2
entries, however large the corpus. Exchange moves one unit at a time to the class that
raises the class bigram likelihood most, until a sweep moves none.

Then every other word seen PLACED times or more is placed: the classes beside all its
occurrences are gathered in its vocabulary slice, and it goes to the class that raises
the likelihood most by the same rule. That is one pass, each word against the table of
the first clustering. Only words too rare to place keep the class of their shape. The
class bigrams are then counted anew over all training tokens.

Smoothing: class transitions are backed off to class frequencies with weight BACK_OFF;
emissions are (count + 0.5) / (class count + 0.5 * (class vocabulary + 1)), so an unseen
word of a class has a count of 0.5. A text begins after an end of text.

Scoring: a batch of documents becomes a sequence of classes, a byte a token; its words
outside the broadcast table are asked for in their slices, each once, and the answers
meet the sequence in the batch's bucket. Batches are told apart by their place in the
input, so rows that repeat an id get results of their own; the input must give its rows
in the same order when a task is repeated, as files do.

Null text is empty: one token, the end. A null id counts as the empty text when folds
are drawn. An empty table gives an empty result; so does training on no text at all:
every count is then 0.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import PACKED, buckets, cut, exchange, gather, integer_key, named, pack, rows, split, unpack
from .textcore import U64, as_bytes, bucket_of, hash_bucket, hash_words, slices, spans

TOP, UNITS, SHAPES, CLASSES, PLACED, BACK_OFF = 65_536, 1000, 16, 64, 3, 10.0
END_WORD, END_SHAPE = U64(0x5DEECE66D1234567), SHAPES
WORDS, RARE, TEXTS, ANSWERS, CONTEXTS = 0, 1, 2, 3, 4
_WORD_TYPES = ("u8", "i4", "u1")
_SLICE_TYPES = ("u8", "i8", "u1")
_PLACED_TYPES = ("u8", "i8", "u1", "u1")
_CONTEXT_TYPES = ("u8", "i4", "u1", "i4", "u1")
_RARE_TYPES = ("i8", "u8")
_ANSWER_TYPES = ("i8", "u1", "i8")
_TEXT_TYPES = ("i8", "i8", "u1", "u1", "i8", "u1", "i4", "i8", "f8")
_RESOLVED_TYPES = ("i8", "u1", "u1", "i8", "i8", "f8", "u1")


def is_held_out(ids: list[int | None]) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1 for i in ids], bool)


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, shape, rows + 1 places) of all words in lower case and each row's end."""
    start, end, first = spans(raw, offsets)
    hashes = hash_words(raw, start, end, lower=True)
    shape = np.zeros(len(start), np.uint8)
    if len(start):
        last = raw[end - 1]
        lower = np.where((last >= 65) & (last <= 90), last + 32, last)
        letter = (lower >= 97) & (lower <= 122)
        vowel = np.isin(lower, np.frombuffer(b"aeiou", np.uint8))
        kind = np.where(last >= 128, 3, np.where(~letter, 2, np.where(vowel, 0, 1)))
        shape = (np.minimum((end - start) // 4, 3) * 4 + kind).astype(np.uint8)
    n = len(first) - 1
    places = first + np.arange(n + 1)
    ends = places[1:] - 1
    out, out_shape = np.empty(len(hashes) + n, np.uint64), np.empty(len(hashes) + n, np.uint8)
    word = np.ones(len(out), bool)
    word[ends] = False
    out[word], out[ends] = hashes, END_WORD
    out_shape[word], out_shape[ends] = shape, END_SHAPE
    return out, out_shape, places


def _pieces(batch: pa.RecordBatch):
    raw, offsets = as_bytes(batch.column(1))
    for lo, hi in slices(offsets):
        yield lo, hi, tokens(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def _training(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.filter(pa.array(~is_held_out(batch.column(0).to_pylist())))


def _counted(n: int):
    """Words of each batch's training texts with counts, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, (hashes, shape, _) in _pieces(_training(batch)):
                words, at, count = np.unique(hashes, return_index=True, return_counts=True)
                found.append((words, count, shape[at]))
            if not found:
                continue
            words, count, shape = (np.concatenate(c) for c in zip(*found, strict=True))
            words, count, shape = _summed(words, count, shape)
            yield from split(hash_bucket(words, n), WORDS, (words, count.astype(np.int32), shape))

    return run


def _summed(words: np.ndarray, count: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(words, kind="stable")
    words = words[order]
    first = np.flatnonzero(np.append(True, words[1:] != words[:-1])) if len(words) else np.zeros(0, np.int64)
    return words[first], np.add.reduceat(count[order].astype(np.int64), first) if len(first) else count[:0].astype(np.int64), shape[order][first]


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vocabulary slice of each bucket: keys ascending, counts, shapes."""
    for bucket, held in gather(batches):
        yield rows([(bucket, WORDS, pack(_summed(*(np.concatenate(c) for c in zip(*(unpack(b, _WORD_TYPES) for _, b in held), strict=True)))))])


def vocabulary_table(docs: DataFrame, n: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, kind, blob): exact counts of all training words."""
    return cut(exchange(docs.select(named(key), named(text)).mapInArrow(_counted(n), PACKED), n).mapInArrow(_sliced, PACKED), "vocabulary")


def _grade(count: np.ndarray) -> np.ndarray:
    """A sixteenth of an octave of a count: some hundred grades, however large the corpus."""
    return np.floor(16 * np.log2(count)).astype(np.int32)


def _graded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, held in gather(batches):
        for _, blob in held:
            grade, n = np.unique(_grade(unpack(blob, _SLICE_TYPES)[1]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grade), pa.array(n.astype(np.int64))], ["grade", "n"])


def _from_grade(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in gather(batches):
            for _, blob in held:
                words, count, shape = unpack(blob, _SLICE_TYPES)
                some = _grade(count) >= least
                yield pa.RecordBatch.from_arrays([pa.array(words[some].view(np.int64)), pa.array(count[some]), pa.array(shape[some].astype(np.int32))], ["word", "count", "shape"])

    return run


def most_frequent(vocabulary: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, counts, shapes) of the TOP most frequent words by falling count, equals by hash.

    Grades of counts are counted first, so that only words near the top are sorted at all.
    """
    grades = sorted(vocabulary.mapInArrow(_graded, "grade int, n bigint").groupBy("grade").agg(F.sum("n").alias("n")).collect(), key=lambda r: -r["grade"])
    least, total = 1 << 30, 0
    for r in grades:
        total, least = total + r["n"], r["grade"]
        if total >= TOP:
            break
    top = vocabulary.mapInArrow(_from_grade(least), "word bigint, count bigint, shape int").orderBy(F.desc("count"), "word").limit(TOP).toArrow()
    words, counts, shapes = (top.column(c).to_numpy() for c in range(3))
    return words.view(np.uint64), counts, shapes


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens and words of each class."""
    for _, held in gather(batches):
        for _, blob in held:
            _, count, _, own = unpack(blob, _PLACED_TYPES)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES, dtype=np.int32)), pa.array(np.bincount(own, count, CLASSES).astype(np.int64)), pa.array(np.bincount(own, minlength=CLASSES).astype(np.int64))], ["class", "n", "v"])


@dataclass
class ClassModel:
    """What is broadcast: bounded by TOP, SHAPES and CLASSES."""

    n_buckets: int
    train_tokens: int
    vocabulary: int
    top_words: np.ndarray
    top_counts: np.ndarray
    top_class: np.ndarray
    shape_class: np.ndarray
    log_transition: np.ndarray
    log_emission_base: np.ndarray


def _found(table: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether there) of each word in an ascending table."""
    if not len(table):
        return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
    at = np.searchsorted(table, words)
    at[at == len(table)] = 0
    return at, table[at] == words


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange_classes(pairs: np.ndarray, classes: int = CLASSES, sweeps: int | None = None) -> np.ndarray:
    """The class of each unit from the matrix of unit bigram counts: frequent units are dealt out first, then moved one by one until none moves."""
    n = len(pairs)
    left, right = pairs.sum(1), pairs.sum(0)
    order = np.argsort(-(left + right), kind="stable")
    member = np.empty(n, np.int64)
    member[order] = np.arange(n) % classes
    one_hot = np.zeros((n, classes))
    one_hot[np.arange(n), member] = 1
    table = one_hot.T @ pairs @ one_hot
    f = _f
    # Above the rounding of the sums, so that every move raises the likelihood and the sweeps end.
    least = 1e-9 + 1e-13 * float(f(pairs.sum()))
    to_class, from_class = pairs @ one_hot, (one_hot.T @ pairs).T.copy()
    own_left, own_right = one_hot.T @ left, one_hot.T @ right
    d = np.arange(classes)
    for _ in itertools.count() if sweeps is None else range(sweeps):
        moved = 0
        for w in order.tolist():
            if not left[w] and not right[w]:
                continue
            k, s = member[w], pairs[w, w]
            r, c = to_class[w].copy(), from_class[w].copy()
            r[k] -= s
            c[k] -= s
            table[k] -= r
            table[:, k] -= c
            table[k, k] -= s
            own_left[k] -= left[w]
            own_right[k] -= right[w]
            ft = f(table)
            gain_row, gain_column = f(table + r[None, :]) - ft, f(table + c[:, None]) - ft
            gain = gain_row.sum(1) - gain_row[d, d] + gain_column.sum(0) - gain_column[d, d]
            gain += f(table[d, d] + r + c + s) - ft[d, d]
            gain -= f(own_left + left[w]) - f(own_left) + f(own_right + right[w]) - f(own_right)
            best = int(np.argmax(gain))
            if gain[best] <= gain[k] + least:
                best = k
            table[best] += r
            table[:, best] += c
            table[best, best] += s
            own_left[best] += left[w]
            own_right[best] += right[w]
            if best != k:
                member[w] = best
                to_class[:, k] -= pairs[:, w]
                to_class[:, best] += pairs[:, w]
                from_class[:, k] -= pairs[w]
                from_class[:, best] += pairs[w]
                moved += 1
        if not moved:
            break
    return member


def place_words(words: np.ndarray, left: np.ndarray, right: np.ndarray, own: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class of each word that raises the class bigram likelihood most, if that word alone moves.

    words: ascending numbers below len(own), one for each occurrence; left and right: classes beside it, CLASSES where that is the word itself.
    """
    out, d = own.copy(), np.arange(CLASSES)
    own_left, own_right = table.sum(1), table.sum(0)
    for lo in range(0, len(own), 1024):
        k = own[lo : lo + 1024].astype(np.int64)
        n = len(k)
        a, b = np.searchsorted(words, (lo, lo + n))
        cell = (words[a:b] - lo) * (CLASSES + 1)
        r = np.bincount(cell + right[a:b], minlength=n * (CLASSES + 1)).reshape(n, CLASSES + 1).astype(float)
        c = np.bincount(cell + left[a:b], minlength=n * (CLASSES + 1)).reshape(n, CLASSES + 1).astype(float)
        s, count = r[:, CLASSES].copy(), r.sum(1)
        r, c = r[:, :CLASSES], c[:, :CLASSES]
        at = np.arange(n)
        inside = np.broadcast_to(np.diag(table), (n, CLASSES)).copy()
        inside[at, k] -= r[at, k] + c[at, k] + s
        gain = _f(inside + r + c + s[:, None]) - _f(inside)
        for side, other, cells in ((r, c, table.T), (c, r, table)):
            w, j = np.nonzero(side)
            if not len(w):
                continue
            base, more = cells[j], side[w, j]
            same = np.flatnonzero(j == k[w])
            base[same] -= other[w[same]]
            rest = np.flatnonzero(j != k[w])
            base[rest, k[w[rest]]] -= more[rest]
            change = _f(base + more[:, None]) - _f(base)
            change[np.arange(len(w)), j] = 0  # the inside of a class is counted above
            first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            gain[w[first]] += np.add.reduceat(change, first, axis=0)
        for sums in (own_left, own_right):
            base = np.broadcast_to(sums, (n, CLASSES)).copy()
            base[at, k] -= count
            gain -= _f(base + count[:, None]) - _f(base)
        best = gain.argmax(1)
        out[lo : lo + n] = np.where(gain[at, best] > gain[at, k] + 1e-9, best, k)
    return out


def _contexts(n: int, core: np.ndarray, core_class: np.ndarray, shape_class: np.ndarray):
    """Of each word outside the core the classes beside its occurrences in training texts, packed by the word's bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, (hashes, shape, _) in _pieces(_training(batch)):
                words = hashes
                at, hit = _found(core, words)
                now = np.where(hit, core_class[at], shape_class[shape]) if len(core) else shape_class[shape]
                # The end of text is no such word, so each has a token behind it; the first one follows an end.
                some = np.flatnonzero(~hit & (shape != END_SHAPE))
                before = np.where(some > 0, now[some - 1], shape_class[END_SHAPE])
                before[(some > 0) & (words[some - 1] == words[some])] = CLASSES
                after = np.where(words[some + 1] == words[some], CLASSES, now[some + 1])
                found.append((words[some], before.astype(np.uint8), after.astype(np.uint8)))
            if not found:
                continue
            words, before, after = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.argsort(words, kind="stable")
            words, times = np.unique(words, return_counts=True)
            yield from split(hash_bucket(words, n), CONTEXTS, (words,), ((times, before[order]), (times, after[order])))

    return run


def _placed(core: np.ndarray, core_class: np.ndarray, shape_class: np.ndarray, table: np.ndarray):
    """The vocabulary slice of each bucket with the words' classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in gather(batches):
            slices_ = [unpack(b, _SLICE_TYPES) for k, b in held if k == WORDS]
            if not slices_:
                continue
            words, count, shape = slices_[0]
            own = shape_class[shape].astype(np.uint8)
            at, hit = _found(core, words)
            own[hit] = core_class[at[hit]]
            move = np.flatnonzero(~hit & (count >= PLACED) & (shape != END_SHAPE))
            met = [unpack(b, _CONTEXT_TYPES) for k, b in held if k == CONTEXTS]
            if met and len(move):
                met_words, times, before, _, after = (np.concatenate(c) for c in zip(*met, strict=True))
                at, hit = _found(words[move], met_words)
                at = np.repeat(np.where(hit, at, -1), times)
                order = np.argsort(at, kind="stable")
                order = order[np.searchsorted(at[order], 0) :]
                own[move] = place_words(at[order], before[order], after[order], own[move], table)
            yield rows([(bucket, WORDS, pack((words, count, shape, own)))])

    return run


def _classes_of(top: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in gather(batches):
            for _, blob in held:
                words, _, _, own = unpack(blob, _PLACED_TYPES)
                hit = _found(top, words)[1]
                yield pa.RecordBatch.from_arrays([pa.array(words[hit].view(np.int64)), pa.array(own[hit].astype(np.int32))], ["word", "class"])

    return run


def place(docs: DataFrame, vocabulary: DataFrame, n: int, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, ClassModel]:
    """The vocabulary with the class of every word, and the model without its class tables."""
    words, counts, shapes = most_frequent(vocabulary)
    n_units, end = UNITS + SHAPES + 1, UNITS + END_SHAPE
    core = np.sort(words[:UNITS][shapes[:UNITS] != END_SHAPE])  # the end of text has its own unit

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(n_units * n_units, np.int64)
        for batch in batches:
            for _, _, (hashes, shape, places) in _pieces(_training(batch)):
                at, hit = _found(core, hashes)
                now = np.where(hit, at, UNITS + shape.astype(np.int64))
                before = np.empty_like(now)
                before[1:] = now[:-1]
                before[places[:-1]] = end
                seen += np.bincount(before * n_units + now, minlength=len(seen))
        where = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), pa.array(seen[where])], ["pair", "n"])

    pairs = np.zeros(n_units * n_units)
    summed = docs.select(named(key), named(text)).mapInArrow(paired, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs[summed.column(0).to_numpy()] = summed.column(1).to_numpy()
    pairs = pairs.reshape(n_units, n_units)
    member = exchange_classes(pairs)
    one_hot = np.zeros((n_units, CLASSES))
    one_hot[np.arange(n_units), member] = 1
    table = one_hot.T @ pairs @ one_hot

    core_class, shape_class = member[: len(core)].astype(np.uint8), member[UNITS:].astype(np.uint8)
    met = docs.select(named(key), named(text)).mapInArrow(_contexts(n, core, core_class, shape_class), PACKED)
    placed = cut(exchange(vocabulary.unionByName(met), n).mapInArrow(_placed(core, core_class, shape_class, table), PACKED), "placed")
    order = np.argsort(words)
    words, counts = words[order], counts[order]
    own = np.zeros(len(words), np.uint8)
    found = placed.mapInArrow(_classes_of(words), "word bigint, class int").toArrow()
    own[np.searchsorted(words, found.column(0).to_numpy().view(np.uint64))] = found.column(1).to_numpy()
    blank = np.zeros(0)
    return placed, ClassModel(n, 0, 0, words, counts, own, shape_class, blank, blank)


def _asked(model: ClassModel):
    """The tokens of each batch as classes (TEXTS, by batch), and its words outside the broadcast table (RARE, by word), each once."""
    n = model.n_buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out = is_held_out(ids)
            null = np.array([i is None for i in ids], bool)
            number = np.array([i or 0 for i in ids], np.int64)
            found = []
            for _, _, (hashes, shape, places) in _pieces(batch):
                words = hashes
                at, hit = _found(model.top_words, words)
                # A byte a token: its class, or CLASSES and its shape if it must be asked for.
                own = np.where(hit, model.top_class[at], CLASSES + shape) if len(model.top_words) else CLASSES + shape
                counted = np.where(hit, np.log10(model.top_counts[at] + 0.5), 0.0) if len(model.top_words) else np.zeros(len(words))
                sums = lambda x, at=places[:-1]: np.add.reduceat(x, at)
                found.append((np.diff(places), sums(hit.astype(np.int64)), sums(counted), own.astype(np.uint8), words[~hit]))
            if not found:
                continue
            n_tokens, n_known, counted, own, words = (np.concatenate(c) for c in zip(*found, strict=True))
            words, number_of = np.unique(words, return_inverse=True)
            head = (np.array([row], np.int64), number, null.astype(np.uint8), out.astype(np.uint8), n_tokens, own, number_of.astype(np.int32))
            at = bucket_of(head[0], n)
            yield rows([(int(at[0]), TEXTS, pack((*head, n_known, counted)))])
            present, edges = np.unique(hash_bucket(words, n), return_index=True)
            edges = np.append(edges, len(words)).tolist()
            parts, size = [], 0
            for i, b in enumerate(present.tolist()):
                parts.append((b, RARE, pack((np.array([row, edges[i]], np.int64), words[edges[i] : edges[i + 1]]))))
                size += len(parts[-1][2])
                if size > 8 << 20:
                    yield rows(parts)
                    parts, size = [], 0
            if parts:
                yield rows(parts)
            row += batch.num_rows

    return run


def _answered(n: int):
    """Class and count of the words that the batches ask for, CLASSES and 0 of unknown ones; texts pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in gather(batches):
            known = [unpack(b, _PLACED_TYPES) for k, b in held if k == WORDS]
            words, count, _, own = known[0] if known else (np.zeros(0, np.uint64), np.zeros(0, np.int64), None, np.zeros(0, np.uint8))
            for kind, blob in held:
                if kind == TEXTS:
                    yield rows([(bucket, TEXTS, blob)])
                elif kind == RARE:
                    head, asked = unpack(blob, _RARE_TYPES)
                    at, hit = _found(words, asked)
                    classes, counts = np.full(len(at), CLASSES, np.uint8), np.zeros(len(at), np.int64)
                    classes[hit], counts[hit] = own[at[hit]], count[at[hit]]
                    yield rows([(int(bucket_of(head[:1], n)[0]), ANSWERS, pack((head, classes, counts)))])

    return run


def _resolved(shape_class: np.ndarray):
    """Each batch with the classes of all tokens, and of each document its known tokens and the sum of log10(count + 0.5)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in gather(batches):
            answers: dict[int, list] = {}
            for blob in (b for k, b in held if k == ANSWERS):
                head, classes, counts = unpack(blob, _ANSWER_TYPES)
                answers.setdefault(int(head[0]), []).append((int(head[1]), classes, counts))
            for blob in (b for k, b in held if k == TEXTS):
                head, number, null, out, n_tokens, own, word, n_known, counted = unpack(blob, _TEXT_TYPES)
                own = own.copy()
                rare = np.flatnonzero(own >= CLASSES)
                told = sorted(answers.pop(int(head[0]), []), key=lambda a: a[0])
                if told:
                    classes, counts = (np.concatenate([a[c] for a in told])[word] for c in (1, 2))
                    own[rare] = np.where(classes < CLASSES, classes, shape_class[np.minimum(own[rare] - CLASSES, SHAPES)])
                    doc = np.repeat(np.arange(len(n_tokens)), n_tokens)[rare]
                    counted = counted + np.bincount(doc, np.log10(counts + 0.5), len(n_tokens))
                    n_known = n_known + np.bincount(doc, counts > 0, len(n_tokens)).astype(np.int64)
                yield rows([(bucket, TEXTS, pack((number, null, out, n_tokens, n_known, counted, own)))])

    return run


def _before(own: np.ndarray, n_tokens: np.ndarray, end: int) -> np.ndarray:
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[np.cumsum(n_tokens) - n_tokens] = end
    return before


def resolve(docs: DataFrame, placed: DataFrame, model: ClassModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    n = model.n_buckets
    asked = docs.select(named(key).cast("long").alias(key), named(text)).mapInArrow(_asked(model), PACKED)
    found = exchange(placed.unionByName(asked), n).mapInArrow(_answered(n), PACKED)
    return cut(exchange(found, n).mapInArrow(_resolved(model.shape_class), PACKED), "classes")


def finish(resolved: DataFrame, placed: DataFrame, model: ClassModel) -> ClassModel:
    """The class tables from the final classes of all training tokens."""
    end = int(model.shape_class[END_SHAPE])

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CLASSES * CLASSES, np.int64)
        for _, held in gather(batches):
            for _, blob in held:
                _, _, out, n_tokens, _, _, own = unpack(blob, _RESOLVED_TYPES)
                pair = _before(own, n_tokens, end).astype(np.int64) * CLASSES + own
                seen += np.bincount(pair[np.repeat(out == 0, n_tokens)], minlength=len(seen))
        where = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), pa.array(seen[where])], ["pair", "n"])

    table = np.zeros(CLASSES * CLASSES)
    summed = resolved.mapInArrow(paired, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    table[summed.column(0).to_numpy()] = summed.column(1).to_numpy()
    table = table.reshape(CLASSES, CLASSES)
    often = table.sum(0)
    share = (often + 0.5) / (often.sum() + 0.5 * CLASSES)
    model.log_transition = np.log10((table + BACK_OFF * share) / (table.sum(1, keepdims=True) + BACK_OFF))
    size, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in placed.mapInArrow(_totals, "class int, n bigint, v bigint").groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        size[r["class"]], kinds[r["class"]] = r["n"], r["v"]
    model.train_tokens, model.vocabulary = int(size.sum()), int(kinds.sum())
    model.log_emission_base = np.log10(size + 0.5 * (kinds + 1))
    return model


OUT = "held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double"


def _scored(model: ClassModel, key: str):
    names = [key, *(c.split()[0] for c in OUT.split(", "))]
    base = np.log10(model.train_tokens + 0.5 * (model.vocabulary + 1))
    end = int(model.shape_class[END_SHAPE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in gather(batches):
            for _, blob in held:
                ids, null, out, n_tokens, n_known, counted, own = unpack(blob, _RESOLVED_TYPES)
                rest = model.log_transition[_before(own, n_tokens, end), own] - model.log_emission_base[own]
                score = counted + np.add.reduceat(rest, np.cumsum(n_tokens) - n_tokens)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(out.astype(bool)), pa.array(n_tokens), pa.array(n_known), pa.array(np.full(len(ids), model.train_tokens)), pa.array(counted - n_tokens * base), pa.array(score), pa.array(10 ** np.minimum(-score / n_tokens, 300))], names
                )

    return run


def class_scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Trains on the documents outside the held-out fold and scores all of them."""
    n = buckets(docs)
    kind = integer_key(docs, key)
    docs = docs.select(named(key).alias(key), named(text).alias("text"))
    placed, model = place(docs, vocabulary_table(docs, n, key), n, key)
    resolved = resolve(docs, placed, model, key)
    return resolved.mapInArrow(_scored(finish(resolved, placed, model), key), f"`{key}` bigint, {OUT}").withColumn(key, named(key).cast(kind))
