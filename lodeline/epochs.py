"""Versions of an index in a folder of any file system that Spark reads.

``versions/<n>.json`` is a manifest: the epoch's folder and what its build reported.
A writer fills a new epoch folder, then commits the next manifest: it is written under a
private name and moved to its own without overwriting, so of two writers
that started from one version a single one wins and the other's ``commit``
raises ``Conflict``. Readers stay with the manifest they have read; an epoch is
whole before any manifest names it. ``vacuum`` deletes epochs that no kept manifest
names, once they are older than a grace period (a build may be under way).
"""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


class Folder:
    """The few file operations that versions need, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession, uri: str):
        self._jvm, self._conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        root = self._jvm.org.apache.hadoop.fs.Path(uri)
        self.fs = root.getFileSystem(self._conf)
        self.uri = str(self.fs.makeQualified(root).toString()).rstrip("/")

    def at(self, *parts: str) -> str:
        return "/".join((self.uri, *parts))

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.at(*parts))

    def exists(self, *parts: str) -> bool:
        return self.fs.exists(self._path(*parts))

    def names(self, *parts: str) -> dict[str, int]:
        """What the folder holds, with the times of change in milliseconds."""
        if not self.exists(*parts):
            return {}
        return {s.getPath().getName(): s.getModificationTime() for s in self.fs.listStatus(self._path(*parts))}

    def read(self, *parts: str) -> str:
        stream = self.fs.open(self._path(*parts))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def delete(self, *parts: str) -> None:
        self.fs.delete(self._path(*parts), True)

    def create_once(self, text: str, *parts: str) -> bool:
        """A whole file under its name, or False if there is one already."""
        final, private = self._path(*parts), self._path(*parts[:-1], f".{uuid.uuid4().hex}")
        stream = self.fs.create(private)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if final.toUri().getScheme() == "file":
                # A local rename would overwrite; a hard link doesn't.
                os.link(private.toUri().getPath(), final.toUri().getPath())
            else:
                plain = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf).rename(private, final, plain)
            return True
        except FileExistsError:
            return False
        except Exception as error:
            if "FileAlreadyExistsException" in str(error):
                return False
            raise
        finally:
            self.fs.delete(private, False)


class Versions:
    def __init__(self, folder: Folder):
        self.folder = folder

    def all(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.folder.names("versions") if n.endswith(".json") and not n.startswith("."))

    def read(self, version: int | None = None) -> dict | None:
        """A manifest with its ``version``; the latest by default, None where there is none."""
        if version is None:
            if not (found := self.all()):
                return None
            version = found[-1]
        return json.loads(self.folder.read("versions", f"{version:012d}.json")) | {"version": version}

    def commit(self, base: int, manifest: dict) -> int:
        """Commits the version after ``base`` (0: the first one)."""
        version = base + 1
        if not self.folder.create_once(json.dumps(manifest, sort_keys=True), "versions", f"{version:012d}.json"):
            raise Conflict(f"version {version} of {self.folder.uri} is another writer's")
        return version

    def vacuum(self, keep: int = 2, grace_seconds: float = 86_400) -> list[str]:
        """Deletes all but the last ``keep`` manifests and the epochs that none of these names, if older than the grace period."""
        old, now = self.all()[: -keep or None], time.time() * 1000
        for version in old:
            self.folder.delete("versions", f"{version:012d}.json")
        named = {self.read(v)["epoch"] for v in self.all()}
        gone = [n for n, changed in self.folder.names().items() if n.startswith("epoch-") and n not in named and now - changed >= grace_seconds * 1000]
        for name in gone:
            self.folder.delete(name)
        return gone
