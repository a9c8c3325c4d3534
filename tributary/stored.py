"""State that outlives a run: immutable tables under a folder, and a manifest of those that count."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from tributary.session import drop_path, file_system


class Manifest:
    """The newest of numbered JSON files under ``path/manifest``.

    A version is written beside the others and then renamed, so a reader sees the old or the new
    one and never a part. Tables are written before the manifest that names them: what a failed run
    leaves behind is named by none and counts for nothing. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        fs, folder = file_system(self.spark, f"{self.path}/manifest")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def read(self) -> dict:
        """The content of the newest version; empty if there is none."""
        versions = self._versions()
        if not versions:
            return {}
        fs, file = file_system(self.spark, f"{self.path}/manifest/{versions[-1]:012d}.json")
        stream = fs.open(file)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, content: dict) -> None:
        """Make ``content`` the newest version. The version before it stays, older ones go."""
        versions = self._versions()
        name = f"{self.path}/manifest/{(versions[-1] + 1 if versions else 0):012d}.json"
        fs, target = file_system(self.spark, name)
        draft = file_system(self.spark, f"{self.path}/manifest/{uuid.uuid4().hex}.draft")[1]
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(draft, target):
            raise RuntimeError(f"{name} exists: another writer is at work")
        for v in versions[:-1]:
            drop_path(self.spark, f"{self.path}/manifest/{v:012d}.json")

    def new_table(self, name: str) -> str:
        """A fresh name for a table under ``path``."""
        return f"{name}-{uuid.uuid4().hex}"

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def drop(self, names: list[str]) -> None:
        """Remove tables that no manifest names any more."""
        for n in names:
            drop_path(self.spark, self.at(n))
