"""Tables in buckets of a key under one manifest: an upsert rewrites the buckets it touches, and all tables change at once.

Folders are written first and the manifest last, under a new number and by renaming, so a
reader sees one version of all tables or the one before it, and a restart goes on from the last.
One writer at a time is assumed; a second one that commits the same version is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KEPT_VERSIONS = 2
#: Input bytes for each bucket of a table that is built, and the fewest buckets.
BUCKET_BYTES, LEAST_BUCKETS = 64 << 20, 16
#: Buckets for each slice that a bucket is written in, so that a key with a large part of all rows is dealt out as tables grow.
SLICE_BUCKETS = 16


class VersionConflict(RuntimeError):
    """Another writer has committed the version that this one was to be."""


def buckets_for(df: DataFrame, least: int = LEAST_BUCKETS) -> int:
    """Buckets by the estimated size of what a frame scans."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return max(least, min(sum(s for s in sizes if s < 1 << 60) // BUCKET_BYTES, 1 << 16))  # an unknown size is the largest long


def bucket_number(value: str, n: int) -> int:
    """The bucket of a string, as bucket() has it, without a job."""
    import xxhash

    h = xxhash.xxh64_intdigest(value.encode(), 42)
    return (h - (1 << 64) if h >> 63 else h) % n


class TableSet:
    """tables: name to (schema, key column, column that deals a bucket's rows out to tasks)."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, tuple[StructType | str, str, str]]):
        self.spark, self.path = spark, path.rstrip("/")
        self.tables = {name: (StructType.fromDDL(s) if isinstance(s, str) else s, key, slicer) for name, (s, key, slicer) in tables.items()}
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def _names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(folder))] if self._fs.exists(self._at(folder)) else []

    def _versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "tables": {name: {"n", "folders": {bucket: folder}}}, "meta"} of a version, the last one if none is named."""
        have = self._versions()
        if not have:
            return {"version": 0, "tables": {}, "meta": {}}
        stream = self._fs.open(self._at(f"manifests/{have[-1] if version is None else version:08d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def bucket(self, value: Column, n: int) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(n)).cast("int")

    def files(self, name: str, folders: dict[str, str], buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of a table in these folders, of all buckets or of some."""
        wanted = folders if buckets is None else {str(b) for b in buckets} & set(folders)
        paths = sorted(f"{self.path}/{folders[b]}" for b in wanted)
        schema = self.tables[name][0]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def rows(self, name: str, buckets: Iterable[int] | None = None, manifest: dict | None = None) -> DataFrame:
        """The rows of a table in the last version, or in a manifest that is already at hand."""
        return self.files(name, (manifest or self.manifest())["tables"].get(name, {"folders": {}})["folders"], buckets)

    def stage(self, name: str, rows: DataFrame, n: int) -> dict[str, str]:
        """Writes rows into a folder of their own, where they do not count yet: {bucket: folder}."""
        schema, key, slicer = self.tables[name]
        folder = f"data-{uuid.uuid4().hex}"
        dealt = rows.select(*schema.names).withColumn("__bucket", self.bucket(F.col(key), n))
        slices = max(1, n // SLICE_BUCKETS)
        dealt = dealt.repartition(F.col("__bucket"), *([F.pmod(F.xxhash64(slicer), F.lit(slices))] if slices > 1 else []))
        dealt.sortWithinPartitions("__bucket", key).write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        return {f.removeprefix("__bucket="): f"{folder}/{f}" for f in self._names(folder) if f.startswith("__bucket=")}

    def publish(self, old: dict, changes: dict[str, tuple[int, dict[str, str], Iterable[int]]], meta: dict | None = None) -> int:
        """Makes staged folders count, for all tables at once: name to (buckets of the table, staged folders, touched buckets)."""
        tables = dict(old["tables"])
        for name, (n, staged, touched) in changes.items():
            gone = {str(b) for b in touched}
            tables[name] = {"n": n, "folders": {b: f for b, f in tables.get(name, {"folders": {}})["folders"].items() if b not in gone} | staged}
        version = old["version"] + 1
        at, part = self._at(f"manifests/{version:08d}.json"), self._at(f"manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(part)
        out.write(bytearray(json.dumps({"version": version, "tables": tables, "meta": old["meta"] | (meta or {})}).encode()))
        out.close()
        if self._fs.exists(at) or not self._fs.rename(part, at):
            self._fs.delete(part, False)
            raise VersionConflict(f"version {version} of {self.path} exists")
        self._expire(version)
        return version

    def _expire(self, version: int) -> None:
        """Deletes manifests before the kept ones, and data that no kept one names, of commits that failed too."""
        have = self._versions()
        kept = [v for v in have if v > version - KEPT_VERSIONS]
        named = {f.split("/")[0] for v in kept for t in self.manifest(v)["tables"].values() for f in t["folders"].values()}
        for v in set(have) - set(kept):
            self._fs.delete(self._at(f"manifests/{v:08d}.json"), False)
        for f in self._names(""):
            if f.startswith("data-") and f not in named:
                self._fs.delete(self._at(f), True)


class BucketedTable(TableSet):
    """One table whose rows are upserted by buckets of a key."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: str = "id", n: int = LEAST_BUCKETS):
        super().__init__(spark, path, {"rows": (schema, key, key)})
        self.n = n

    def read(self, buckets: Iterable[int] | None = None) -> DataFrame:
        return self.rows("rows", buckets)

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets in which rows lie: at most as many as there are."""
        return [r[0] for r in rows.select(self.bucket(F.col(self.tables["rows"][1]), self.n)).distinct().collect()]

    def commit(self, rows: DataFrame, touched: Iterable[int], meta: dict | None = None) -> int:
        """Replaces the touched buckets by these rows, which must all lie in them."""
        return self.publish(self.manifest(), {"rows": (self.n, self.stage("rows", rows, self.n), touched)}, meta)
