"""Commits of a versioned folder: one small JSON file a version, created only if no one else has created it."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class ConflictingWrite(RuntimeError):
    """Another writer committed the version first; load again and repeat the work."""


class Folder:
    """Files of a folder on any file system Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    @property
    def files(self):
        return self.at("").getFileSystem(self._conf)

    def names(self, below: str = "", older_than_ms: int | None = None) -> list[str]:
        """Names in the folder or one below it, sorted; none if there is no such folder."""
        if not self.files.exists(self.at(below)):
            return []
        found = self.files.listStatus(self.at(below))
        return sorted(s.getPath().getName() for s in found if older_than_ms is None or s.getModificationTime() < older_than_ms)

    def read(self, name: str) -> str:
        stream = self.files.open(self.at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str, replace: bool = False) -> None:
        """Write a whole file or none: under another name first, then renamed. Without ``replace`` an existing file stays, and
        ``ConflictingWrite`` is raised."""
        temporary = self.at(f"_temporary-{uuid.uuid4().hex}")
        out = self.files.create(temporary, True)
        out.write(bytearray(text.encode()))
        out.close()
        rename = self._hadoop.Options.Rename
        options = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = rename.OVERWRITE if replace else rename.NONE
        final = self.files.makeQualified(self.at(name))
        try:
            self._hadoop.FileContext.getFileContext(final.toUri(), self._conf).rename(self.files.makeQualified(temporary), final, options)
        except Py4JJavaError as failure:
            self.files.delete(temporary, False)
            if "FileAlreadyExistsException" not in str(failure):
                raise
            raise ConflictingWrite(f"{self.path}/{name} exists already") from failure

    def delete(self, name: str) -> None:
        self.files.delete(self.at(name), True)


class CommitLog:
    """Versions from 0 on; a version's record says all that a reader of it needs."""

    def __init__(self, spark: SparkSession, path: str):
        self.folder = Folder(spark, path)

    @staticmethod
    def _name(version: int) -> str:
        return f"v={version:012d}.json"

    def versions(self) -> list[int]:
        return [int(name[2:-5]) for name in self.folder.names() if name.startswith("v=") and name.endswith(".json")]

    def latest(self) -> int | None:
        return max(self.versions(), default=None)

    def read(self, version: int) -> dict:
        return json.loads(self.folder.read(self._name(version)))

    def append(self, version: int, record: dict) -> None:
        self.folder.write(self._name(version), json.dumps(record))

    def forget(self, version: int) -> None:
        self.folder.delete(self._name(version))
