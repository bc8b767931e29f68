"""A log of versions on a shared file system, for tables that several jobs write.

A version is one small JSON file. It is written under another name first and then given its own name, which
fails if that name is taken; so a version is whole or absent, and one of two writers of a version loses
and starts over from what the other published.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class CommitConflict(Exception):
    """Another writer published a version that this change cannot follow."""


class FileSystem:
    """The few file operations that the store needs, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def escape(self, name: str) -> str:
        """A partition value as Spark writes it in a folder name."""
        return self.jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(name)

    def unescape(self, name: str) -> str:
        return self.jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(name)

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        """Names in a folder, in order; none when there is no such folder."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if not s.getPath().getName().startswith(("_", ".")))

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        if fs.exists(p):
            fs.delete(p, True)

    def text(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, path: str, text: str) -> None:
        """Write a file whole: under another name first, then over whatever has the name."""
        fs, p = self._at(path)
        self._rename(self._write_aside(fs, p, text), p, "OVERWRITE")

    def put_if_absent(self, path: str, text: str) -> bool:
        """Write a file whole unless its name is taken; whether it was written."""
        fs, p = self._at(path)
        aside = self._write_aside(fs, p, text)
        try:
            if p.getFileSystem(self.conf).getScheme() == "file":
                # a rename on this file system replaces; a link does not
                link = self.jvm.java.nio.file.Files.createLink
                local = [self.jvm.java.io.File(x.toUri().getPath()).toPath() for x in (p, aside)]
                link(*local)
            else:
                self._rename(aside, p, "NONE")
            return True
        except Py4JJavaError as exc:
            if "AlreadyExists" in exc.java_exception.getClass().getName():
                return False
            raise
        finally:
            if fs.exists(aside):
                fs.delete(aside, False)

    def _write_aside(self, fs, p, text: str):
        aside = self.jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{uuid.uuid4().hex}.tmp")
        out = fs.create(aside, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return aside

    def _rename(self, source, target, option: str) -> None:
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.gateway.new_array(rename, 1)
        options[0] = getattr(rename, option)
        source = source.makeQualified(source.getFileSystem(self.conf).getUri(), None)
        target = target.makeQualified(target.getFileSystem(self.conf).getUri(), None)
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.conf).rename(source, target, options)


class CommitLog:
    """Versions 0, 1, 2, ... of a state (a dict) below one folder."""

    def __init__(self, files: FileSystem, folder: str):
        self.files, self.folder = files, folder

    def _path(self, version: int) -> str:
        return f"{self.folder}/{version:020d}.json"

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(self.folder) if n.endswith(".json"))

    def read(self, version: int) -> dict:
        return json.loads(self.files.text(self._path(version)))

    def latest(self) -> dict | None:
        versions = self.versions()
        return self.read(versions[-1]) if versions else None

    def commit(self, step) -> dict:
        """Publish ``step(latest state or None)`` as the next version; again from the newest state when
        another writer was faster. ``step`` returns None for no change, or raises ``CommitConflict``."""
        while True:
            latest = self.latest()
            state = step(latest)
            if state is None:
                return latest
            state = {**state, "version": latest["version"] + 1 if latest else 0}
            if self.files.put_if_absent(self._path(state["version"]), json.dumps(state)):
                return state

    def forget(self, version: int) -> None:
        self.files.delete(self._path(version))
