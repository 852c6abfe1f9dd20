"""Keyed tables whose writes move only what changed.

Rows lie in buckets by a hash of their keys. A write reads and rewrites the buckets that its batch touches, as files of their
own, and is there once a manifest names them: readers take the last manifest and so see a table before or after a write,
never in between. The manifest also keeps the last batch taken from each source, so a batch that comes again, after a failure
between the write and the stream's own commit, changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class Conflict(RuntimeError):
    """Another writer has committed in the meantime; nothing was changed."""


class KeyedTable:
    """A table under path, in any store that Spark writes to; keys say which rows belong together. One writer at a time wins.

    Key columns may be null; what has equal keys lies in one bucket. buckets is fixed when the table begins.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], *, buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._text = jvm.org.apache.commons.io.IOUtils
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ------------------------------------------------------------ manifests

    def versions(self) -> list[int]:
        folder = self._at(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """version, buckets, parts (bucket -> folder) and applied (source -> last batch)."""
        found = self.versions()
        if not found:
            return {"version": -1, "buckets": self.buckets, "parts": {}, "applied": {}}
        stream = self._fs.open(self._at(f"{self.path}/manifests/{found[-1] if version is None else version:012d}.json"))
        try:
            return json.loads(self._text.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        draft, final = self._at(f"{self.path}/manifests/.{uuid.uuid4().hex}"), self._at(f"{self.path}/manifests/{manifest['version']:012d}.json")
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise Conflict(f"version {manifest['version']} of {self.path} is there already")

    # ------------------------------------------------------------ rows

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")

    def _rows(self, manifest: dict, buckets: list[str]) -> DataFrame:
        paths = [f"{self.path}/{manifest['parts'][b]}/_bucket={b}" for b in buckets if b in manifest["parts"]]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The whole table as the last write left it, or an earlier one."""
        found = self.manifest(version)
        return self._rows(found, list(found["parts"]))

    def apply(self, batch: DataFrame, merge: Merge, *, source: str | None = None, number: int | None = None) -> list[int]:
        """Set the table to merge(its rows, batch), for the buckets that batch's keys fall in; returns those buckets.

        merge must treat keys independently, as the functions of operators/store.py do. A batch whose number isn't above the
        last one of its source is passed over. An empty batch is noted, too.
        """
        old = self.manifest()
        if source is not None and number is not None and number <= old["applied"].get(source, -1):
            return []
        bucket = self._bucket(old["buckets"])
        touched = sorted(r[0] for r in batch.select(bucket).distinct().collect())  # as many as there are buckets at most
        parts, folder = dict(old["parts"]), f"data/{uuid.uuid4().hex}"
        if touched:
            rows = merge(self._rows(old, [str(b) for b in touched]), batch).select(*self.spark.createDataFrame([], self.schema).columns)
            rows.withColumn("_bucket", bucket).repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
            there = {s.getPath().getName().removeprefix("_bucket=") for s in self._fs.listStatus(self._at(f"{self.path}/{folder}"))}
            for b in map(str, touched):
                if b in there:
                    parts[b] = folder
                else:  # its last row went
                    parts.pop(b, None)
        applied = old["applied"] | ({source: number} if source is not None and number is not None else {})
        self._commit({"version": old["version"] + 1, "buckets": old["buckets"], "parts": parts, "applied": applied})
        return touched

    def forget(self, keep: int = 1) -> int:
        """Delete the files that none of the last `keep` versions names, and their manifests; returns how many folders went.
        Only where no reader of an earlier version and no other writer is at work."""
        found = self.versions()
        used = {p for v in found[-keep:] for p in self.manifest(v)["parts"].values()}
        for v in found[:-keep]:
            self._fs.delete(self._at(f"{self.path}/manifests/{v:012d}.json"), False)
        data = self._at(f"{self.path}/data")
        gone = [s.getPath() for s in self._fs.listStatus(data) if f"data/{s.getPath().getName()}" not in used] if self._fs.exists(data) else []
        for path in gone:
            self._fs.delete(path, True)
        return len(gone)
