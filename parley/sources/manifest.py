"""A commit log: numbered manifests, each the whole list of what a table consists of, published one after the other.

A manifest is written to a file of its own and published under the next number only if nobody has taken it: a hard link on
a local file system, a rename that does not overwrite elsewhere (the store must have one of the two). Who loses reads the
winner's manifest, and decides anew. Readers see the manifest with the highest number, so they see whole commits only; what
a writer that died has left behind is in no manifest.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

KEPT_VERSIONS = 100
_NAME = re.compile(r"(\d{20})\.json")


class Files:
    """The few file operations that commits need, through Hadoop's file systems (any store that Spark reads)."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def names(self, folder: str) -> list[str]:
        fs, p = self._at(folder)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def age_s(self, path: str, now_ms: int) -> float:
        fs, p = self._at(path)
        return (now_ms - fs.getFileStatus(p).getModificationTime()) / 1000

    def set_time(self, path: str, ms: int) -> None:
        fs, p = self._at(path)
        fs.setTimes(p, ms, -1)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        fs, p = self._at(path)
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def publish(self, source: str, target: str) -> bool:
        """Give the written file ``source`` the name ``target``; False if something has that name."""
        fs, p = self._at(source)
        _, q = self._at(target)
        try:
            if fs.getScheme() == "file":
                plain = [self.jvm.java.io.File(x.toUri().getPath()).toPath() for x in (q, p)]
                self.jvm.java.nio.file.Files.createLink(*plain)
            else:
                kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
                none = self.jvm.java.lang.reflect.Array.newInstance(kind.NONE.getClass(), 1)
                none[0] = kind.NONE
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.conf).rename(p, q, none)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True


class CommitLog:
    def __init__(self, spark: SparkSession, folder: str, empty: dict):
        self.files, self.folder, self.empty = Files(spark), folder, empty

    def versions(self) -> list[int]:
        return sorted(int(m[1]) for m in map(_NAME.fullmatch, self.files.names(self.folder)) if m)

    def _path(self, version: int) -> str:
        return f"{self.folder}/{version:020d}.json"

    def latest(self) -> dict:
        """The last manifest, with its number as ``version`` (0: nothing committed yet)."""
        found = self.versions()
        if not found:
            return {**self.empty, "version": 0}
        return {**self.empty, **json.loads(self.files.read(self._path(found[-1]))), "version": found[-1]}

    def commit(self, change: Callable[[dict], dict | None], seen: dict | None = None) -> dict:
        """Publish ``change`` of the last manifest. If another commit comes first, ``change`` is asked again with its manifest;
        it may do work, raise, or give None for nothing to commit."""
        seen = seen or self.latest()
        while True:
            new = change(seen)
            if new is None:
                return seen
            new = {**new, "version": seen["version"] + 1}
            draft = f"{self.folder}/.draft-{uuid.uuid4().hex}"
            self.files.write(draft, json.dumps(new))
            try:
                won = self.files.publish(draft, self._path(new["version"]))
            finally:
                self.files.delete(draft)
            if won:
                self._forget(new["version"])
                return new
            seen = self.latest()

    def _forget(self, version: int) -> None:
        """Old manifests go, so that a listing stays short."""
        if version % KEPT_VERSIONS == 0:
            for v in self.versions():
                if v <= version - KEPT_VERSIONS:
                    self.files.delete(self._path(v))
