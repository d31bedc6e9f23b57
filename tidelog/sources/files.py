"""Files of a folder through Hadoop's file systems: local paths, ``hdfs://``, ``s3a://`` and whatever else the session knows."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

#: Parts of error texts that call for another try. Fixed values.
TRANSIENT = ("throttl", "slow down", "timeout", "timed out", "503", "too many requests")


def retried(call: Callable, tries: int = 4, pause_s: float = 0.01):
    """``call()``; on errors that pass, up to ``tries`` times with doubled pauses between."""
    for n in range(tries):
        try:
            return call()
        except Exception as error:
            if n + 1 == tries or not any(t in str(error).lower() for t in TRANSIENT):
                raise
            time.sleep(pause_s * 2**n)


class Files:
    """The storage interface of stores, archives and blobs."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.at(name))

    def exists(self, name: str = "") -> bool:
        return bool(self._fs.exists(self._path(name)))

    def names(self, folder: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder))) if self.exists(folder) else []

    def complete(self, folder: str) -> list[str]:
        """Folders below ``folder`` that a job has finished."""
        return [n for n in self.names(folder) if self.exists(f"{folder}/{n}/_SUCCESS")]

    def size(self, name: str) -> int:
        """Bytes of a file or of all files of a folder."""
        return int(self._fs.getContentSummary(self._path(name)).getLength()) if self.exists(name) else 0

    def read(self, name: str) -> bytes | None:
        if not self.exists(name):
            return None
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, name: str, data: bytes) -> bool:
        """Write a new file; False, and nothing done, if there is one."""
        try:
            stream = self._fs.create(self._path(name), False)
        except Exception as error:
            if "AlreadyExists" in str(error) or self.exists(name):
                return False
            raise
        stream.write(bytearray(data))
        stream.close()
        return True

    def write(self, name: str, data: bytes) -> None:
        """Write a file under its name only when it is complete."""
        part = f"{name}.{uuid.uuid4().hex}.tmp"
        self.create(part, data)
        if self.exists(name):
            self.delete(name)
        if not self.rename(part, name):
            raise OSError(f"could not write {self.at(name)}")

    def make(self, folder: str) -> None:
        self._fs.mkdirs(self._path(folder))

    def rename(self, name: str, new: str) -> bool:
        return bool(self._fs.rename(self._path(name), self._path(new)))

    def delete(self, name: str) -> bool:
        return bool(self._fs.delete(self._path(name), True))


class BlobFolder:
    """Content-addressed blobs on any Hadoop file system: a name is the content's hash; ``kind`` tells segments from what goes with them."""

    def __init__(self, spark: SparkSession, path: str):
        self.files = Files(spark, path)

    @staticmethod
    def _name(digest: str, kind: str) -> str:
        if not digest or any(c not in "0123456789abcdef" for c in digest):
            raise ValueError(f"no hash: {digest!r}")
        return f"{digest}.{kind}"

    def upload(self, data: bytes, kind: str = "seg") -> str:
        digest = hashlib.sha256(data).hexdigest()
        retried(lambda: self.files.write(self._name(digest, kind), data))
        return digest

    def upload_if_absent(self, data: bytes, kind: str = "seg") -> bool:
        return retried(lambda: self.files.create(self._name(hashlib.sha256(data).hexdigest(), kind), data))

    def upload_aux(self, digest: str, data: bytes, kind: str) -> None:
        """A file beside a blob, under the blob's hash."""
        retried(lambda: self.files.write(self._name(digest, kind), data))

    def download(self, digest: str, kind: str = "seg") -> bytes | None:
        """The blob, None if there is none; a segment whose content isn't its name's is an error."""
        data = retried(lambda: self.files.read(self._name(digest, kind)))
        if data is not None and kind == "seg" and hashlib.sha256(data).hexdigest() != digest:
            raise ValueError(f"blob {digest} is damaged")
        return data

    def list(self, kind: str = "seg") -> list[str]:
        return [n[: -len(kind) - 1] for n in self.files.names() if n.endswith(f".{kind}")]

    def delete(self, digest: str, kind: str = "seg") -> None:
        self.files.delete(self._name(digest, kind))
