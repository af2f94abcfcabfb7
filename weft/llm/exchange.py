"""Packed exchange: numpy columns travel between tasks as one binary row for each batch and bucket.

A row a word would cost the JVM about a microsecond in each of serialising, sorting
and reading. Packing leaves the shuffle a few large rows; buckets grow in number with
the input, so that what one task unpacks stays bounded.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .memory import give_back

PACKED = "bucket int, kind int, blob binary"
SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
#: Estimated input bytes for each bucket, if the session asks for fewer shuffle partitions.
BUCKET_BYTES = 32 << 20


def named(column: str) -> Column:
    """A column by its plain name, whatever characters that holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def ddl(fields) -> str:
    """Fields as a schema string, whatever characters their names hold."""
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in fields)


def integer_key(df: DataFrame, key: str) -> str:
    """The type of a key that travels as a 64-bit integer; other types are refused by name."""
    kind = df.schema[key].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{key!r} must be of an integer type, not {kind}")
    return kind


def buckets(df: DataFrame) -> int:
    """As many as shuffle partitions, or more if the estimated size of what is scanned asks for more."""
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(s for s in sizes if s < 1 << 60)  # Spark's word for an unknown size is the largest long
    return max(wanted, min(known // BUCKET_BYTES, 1 << 20), 1)


def pack(columns: Sequence[np.ndarray]) -> bytes:
    """Columns of any lengths and types as bytes; the reader names the types."""
    head = np.array([len(c) for c in columns], np.int64)
    return b"".join([head.tobytes(), *(np.ascontiguousarray(c).tobytes() for c in columns)])


def unpack(blob: bytes, types: Sequence[str]) -> list[np.ndarray]:
    give_back()
    lengths = np.frombuffer(blob, np.int64, len(types))
    at, out = 8 * len(types), []
    for kind, n in zip(types, lengths, strict=True):
        out.append(np.frombuffer(blob, kind, int(n), at))
        at += int(n) * np.dtype(kind).itemsize
    return out


def squeezed(columns: Sequence[np.ndarray]) -> bytes:
    """Columns as pack() has them, compressed. Numbers lie as planes of their first, second, ... bytes, of which high ones take next to nothing."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.ravel() for c in columns]
    raw = np.array([len(c) for c in columns], np.int64).tobytes() + b"".join([x.tobytes() for x in planes])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def opened(blob: bytes, types: Sequence[str]) -> list[np.ndarray]:
    """What squeezed() has packed; the reader names the types."""
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    at, out = 8 * len(types), []
    for kind, n in zip(types, np.frombuffer(raw, np.int64, len(types)).tolist(), strict=True):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def rows(parts: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    """A batch of packed rows."""
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.int32()), pa.array([p[2] for p in parts], pa.binary())], schema=SCHEMA)


def split(bucket: np.ndarray, kind: int, columns: Sequence[np.ndarray], hanging: Sequence[tuple[np.ndarray, np.ndarray]] = (), counted: str = "i4") -> Iterator[pa.RecordBatch]:
    """Rows for each bucket. hanging: (counts, values) of variable length for each element; counts are packed before their values, in the type named by counted."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    own_bucket = bucket[order]
    heads = np.flatnonzero(np.append(True, own_bucket[1:] != own_bucket[:-1]))
    columns = [c[order] for c in columns]
    hung = []
    for counts, values in hanging:
        begin = np.cumsum(counts) - counts
        begin, counts = begin[order], counts[order]
        total = int(counts.sum())
        offset = np.cumsum(counts) - counts
        hung.append((counts, np.append(offset, total), values[np.arange(total) + np.repeat(begin - offset, counts)]))
    parts, size = [], 0
    for lo, hi in zip(heads.tolist(), [*heads[1:].tolist(), len(order)], strict=True):
        b = int(own_bucket[lo])
        own = [c[lo:hi] for c in columns]
        for counts, offset, values in hung:
            own += [counts[lo:hi].astype(counted), values[offset[lo] : offset[hi]]]
        parts.append((b, kind, pack(own)))
        size += len(parts[-1][2])
        if size > 8 << 20:
            yield rows(parts)
            parts, size = [], 0
    if parts:
        yield rows(parts)


def exchange(packed: DataFrame, n: int) -> DataFrame:
    """Each bucket's rows in one task, bucket by bucket and kind by kind."""
    return packed.repartitionById(n, packed["bucket"]).sortWithinPartitions("bucket", "kind")


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """(bucket, [(kind, blob), ...]) for each bucket of the task."""
    current, held = None, []
    for batch in batches:
        blobs = batch.column(2)
        for i, (bucket, kind) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if bucket != current and current is not None:
                yield current, held
                held = []
            current = bucket
            held.append((kind, blobs[i].as_py()))
    if current is not None:
        yield current, held


_own: dict[str, str] = {}


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode where the session names none, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if "dir" not in _own:
            _own["dir"] = "file://" + tempfile.mkdtemp(prefix="weft-")
        where = _own["dir"]
    return f"{where.rstrip('/')}/weft-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application has cut; call it once their results are written elsewhere."""
    _delete(spark, shared(spark))


def cut(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Writes a table into the shared folder and reads it back, which ends its lineage."""
    return cut_at(df, name, compression)[0]


def cut_at(df: DataFrame, name: str, compression: str | None = None) -> tuple[DataFrame, str]:
    path = f"{shared(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def replaced(df: DataFrame, name: str, before: str) -> tuple[DataFrame, str]:
    """Cuts a step of an iteration and deletes the step before it, which only this one read."""
    now = cut_at(df, name)
    _delete(df.sparkSession, before)
    return now
