"""Small-file storage through Hadoop's file systems, so any store that Spark can reach works."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import SparkSession

from tidemark.errors import RetryableCommit, TransactionError

#: How a scheme puts a whole file only if it is absent: by a hard link, by a rename that never replaces, or because a file
#: that must not replace another appears, if at all, when it is closed.
EXCLUSIVE = {"file": "link", "hdfs": "rename", "webhdfs": "rename", "viewfs": "rename", "abfs": "rename", "abfss": "rename", "gs": "create"}


@dataclass(frozen=True)
class Status:
    path: str
    name: str
    size: int
    mtime: int
    is_dir: bool


class Storage:
    """List, read, put, copy and rename below one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self._jvm = spark, spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        path = self._path(root)
        self.fs = path.getFileSystem(self.conf)
        self.root = self.fs.makeQualified(path).toString().rstrip("/")

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def absolute(self, relative: str) -> str:
        """A decoded path: absolute ones stay."""
        return relative if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/|/", relative) else f"{self.root}/{relative}"

    def uri(self, path: str) -> str:
        """An absolute path as Spark reports a scanned file: qualified and encoded."""
        if re.fullmatch(r"[\w/.=:~-]+", path, re.A) and re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path):
            return path
        return self.fs.makeQualified(self._path(path)).toUri().toString()

    def list(self, path: str) -> list[Status]:
        """Files of a folder by name; none if it does not exist."""
        p = self._path(path)
        if not self.fs.exists(p):
            return []
        found = [Status(s.getPath().toString(), s.getPath().getName(), s.getLen(), s.getModificationTime(), s.isDirectory()) for s in self.fs.listStatus(p)]
        return sorted(found, key=lambda s: s.name)

    def walk(self, path: str) -> list[Status]:
        """All files below a folder."""
        p, found = self._path(path), []
        if not self.fs.exists(p):
            return []
        files = self.fs.listFiles(p, True)
        while files.hasNext():
            s = files.next()
            found.append(Status(s.getPath().toString(), s.getPath().getName(), s.getLen(), s.getModificationTime(), False))
        return sorted(found, key=lambda s: s.path)

    def head(self, path: str) -> Status | None:
        p = self._path(path)
        if not self.fs.exists(p):
            return None
        s = self.fs.getFileStatus(p)
        return Status(s.getPath().toString(), s.getPath().getName(), s.getLen(), s.getModificationTime(), s.isDirectory())

    def read(self, path: str) -> bytes:
        stream = self.fs.open(self._path(path))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def put(self, path: str, data: bytes, overwrite: bool = False) -> None:
        """Writes a whole file; FileExistsError if it is there and must not be replaced."""
        p = self._path(path)
        if not overwrite and self.fs.exists(p):
            raise FileExistsError(path)
        try:
            stream = self.fs.create(p, overwrite)
        except Exception as e:
            if self.fs.exists(p) and not overwrite:
                raise FileExistsError(path) from e
            raise RetryableCommit(str(e)) from e
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def put_if_absent(self, path: str, data: bytes) -> None:
        """Puts a whole file in one step: of several writers one succeeds, the others get FileExistsError, and readers see all or nothing."""
        scheme = self.fs.getUri().getScheme()
        how = EXCLUSIVE.get(scheme)
        if how is None:
            raise TransactionError(f"{scheme}: cannot put a file only if it is absent; commit through a catalog")
        if how == "create":
            return self.put(path, data)
        folder, name = path.rsplit("/", 1)
        temp = f"{folder}/_{name}.{uuid.uuid4().hex}.tmp"
        self.put(temp, data)
        try:
            if how == "link":
                local = lambda x: self._jvm.java.nio.file.Paths.get(same_path(decode_path(self.uri(x))), self.spark._sc._gateway.new_array(self._jvm.java.lang.String, 0))
                self._jvm.java.nio.file.Files.createLink(local(path), local(temp))
            else:
                none = self.spark._sc._gateway.new_array(getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self._path(temp), self._path(path), none)
        except Exception as e:
            if self.fs.exists(self._path(path)):
                raise FileExistsError(path) from e
            raise RetryableCommit(str(e)) from e
        finally:
            self.fs.delete(self._path(temp), False)

    def copy(self, source: str, target: str) -> None:
        """Copies a file in one step; FileExistsError if the target is there."""
        self.put_if_absent(target, self.read(source))

    def rename(self, source: str, target: str) -> None:
        self.fs.mkdirs(self._path(target).getParent())
        if not self.fs.rename(self._path(source), self._path(target)):
            raise FileExistsError(target)

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)


def encode_path(path: str) -> str:
    """A path as a URI path, as it stands in the log."""
    return quote(path, safe="/=:@!$&'()*+,;~-._")


def decode_path(path: str) -> str:
    return unquote(path)


def same_path(path: str) -> str:
    """One spelling for a decoded absolute path."""
    return re.sub(r"^file:/*", "/", path)
