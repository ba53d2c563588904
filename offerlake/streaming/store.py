"""A versioned table in Parquet, in buckets: a commit rewrites the buckets it touches and no others.

A version is a manifest, a small file that names the folder of each bucket; renaming it to its place makes the version
count. A commit of a version that is there changes nothing, so a micro-batch may run again. Readers take the manifest
of a version, so they never see half a commit, and older versions stay readable until they are forgotten.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class BucketedStore:
    def __init__(self, spark: SparkSession, root: str, keys: list[str], schema: T.StructType, buckets: int = 32):
        self.spark, self.root, self.keys, self.schema, self.buckets = spark, root, keys, schema, buckets
        self._jvm = spark.sparkContext._jvm
        self._files = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self._files.listStatus(path)] if self._files.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self._names("manifest") if n.startswith("v") and n.endswith(".json"))

    def committed(self, version: int) -> bool:
        return self._files.exists(self._path("manifest", f"v{version}.json"))

    def manifest(self, version: int | None = None) -> dict[int, str]:
        """Bucket to folder as of a version (the last one up to it); the last version if none is given."""
        known = [v for v in self.versions() if version is None or v <= version]
        if not known:
            return {}
        stream = self._files.open(self._path("manifest", f"v{known[-1]}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(b): f for b, f in json.loads(text).items()}

    def _write_manifest(self, version: int, held: dict[int, str]) -> None:
        part = self._path("manifest", f".{uuid.uuid4().hex}")
        out = self._files.create(part, False)
        try:
            out.write(bytearray(json.dumps(held), "utf-8"))
        finally:
            out.close()
        self._files.rename(part, self._path("manifest", f"v{version}.json"))

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of some rows' keys."""
        return sorted(rows.agg(F.collect_set(self.bucket())).first()[0])  # as many as there are buckets at most

    def read(self, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        held = self.manifest(version)
        chosen = held.keys() if buckets is None else held.keys() & set(buckets)
        folders = [f"{self.root}/{held[b]}" for b in sorted(chosen)]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema).limit(0)

    def commit(self, version: int, rows: DataFrame, touched: Iterable[int], beside: Sequence[str] = ()) -> bool:
        """Replaces the touched buckets by the rows, all of which lie in them. False if the version was there.

        Columns beyond the schema may be there for what observes the rows; only those named ``beside`` are written, for ``written``.
        """
        if self.committed(version):
            return False
        held = {b: f for b, f in self.manifest(version).items() if b not in set(touched)}
        data = f"data/v{version}"
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]
        rows.select(*columns, *beside, self.bucket().alias("_bucket")).write.mode("overwrite").option("compression", "zstd").partitionBy("_bucket").parquet(f"{self.root}/{data}")
        held |= {int(n.split("=")[1]): f"{data}/{n}" for n in self._names(data) if n.startswith("_bucket=")}
        self._write_manifest(version, held)
        return True

    def written(self, version: int, columns: str) -> DataFrame:
        """What the commit of a version wrote, with columns beside the schema's."""
        return self.spark.read.schema(columns).parquet(f"{self.root}/data/v{version}")

    def forget(self, version: int) -> None:
        """Deletes the versions before a committed one, and the folders that only they name."""
        for old in self.versions():
            if old < version:
                self._files.delete(self._path("manifest", f"v{old}.json"), False)
        held = {f for v in self.versions() for f in self.manifest(v).values()}
        for data in (f"data/{n}" for n in self._names("data") if int(n[1:]) < version):
            folders = [f"{data}/{n}" for n in self._names(data) if n.startswith("_bucket=")]
            for gone in [f for f in folders if f not in held] if held.intersection(folders) else [data]:
                self._files.delete(self._path(gone), True)
