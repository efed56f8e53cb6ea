"""Versioned storage of a collection: Parquet segments and a JSON manifest for each version.

A commit writes its segments first and then, in one rename, the manifest of the next
version. Readers pin a version; a failed writer leaves files that no manifest names. All files go
through Hadoop's file system interface, so any store that Spark reads will do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import AlreadyExists, FailedPrecondition, NotFound


class Store:
    """The folder of one collection."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _p(self, name: str = ""):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self) -> bool:
        return self._fs.exists(self._p("_manifests"))

    def versions(self) -> list[int]:
        if not self.exists():
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._p("_manifests"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def read(self, version: int | None = None) -> dict:
        """The manifest of a version, by default the latest."""
        have = self.versions()
        if not have or version is not None and version not in have:
            raise NotFound(f"no collection at {self.path}" if not have else f"no version {version}")
        stream = self._fs.open(self._p(f"_manifests/v{have[-1] if version is None else version:09d}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def commit(self, manifest: dict) -> dict:
        """Publish the next version; another writer's commit in between is an error."""
        name = f"v{manifest['version']:09d}.json"
        if self._fs.exists(self._p(f"_manifests/{name}")):
            raise FailedPrecondition(f"version {manifest['version']} was committed by another writer")
        self._fs.mkdirs(self._p("_manifests"))
        temp = self._p(f"_manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(temp)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if not self._fs.rename(temp, self._p(f"_manifests/{name}")):
            self._fs.delete(temp, False)
            raise FailedPrecondition(f"version {manifest['version']} was committed by another writer")
        return manifest

    def create(self, manifest: dict) -> dict:
        if self._fs.exists(self._p()):
            raise AlreadyExists(self.path)
        return self.commit(manifest)

    def write_segment(self, df: DataFrame) -> str:
        """Write rows as a new segment; its name."""
        name = f"segments/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def segment(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def drop_segment(self, name: str) -> None:
        """Delete a segment that no manifest names."""
        self._fs.delete(self._p(name), True)

    def vacuum(self, keep: int = 1) -> int:
        """Drop manifests but the last ``keep``, and segments and index tables that none of these names; how many files went."""
        have = self.versions()
        kept = [self.read(v) for v in have[-keep:]]
        named = {s["name"] for m in kept for s in m["segments"]} | {x["path"] for m in kept for x in m.get("side", {}).values()}
        named |= {x["path"] for m in kept for s in m["segments"] for x in s.get("text", {}).values()}
        gone = 0
        for v in have[:-keep]:
            gone += self._fs.delete(self._p(f"_manifests/v{v:09d}.json"), False)
        for folder in ("segments", "side"):
            if self._fs.exists(self._p(folder)):
                for s in self._fs.listStatus(self._p(folder)):
                    if f"{folder}/{s.getPath().getName()}" not in named:
                        gone += self._fs.delete(s.getPath(), True)
        return gone

    def destroy(self) -> None:
        self._fs.delete(self._p(), True)
