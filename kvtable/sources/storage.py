"""Small file operations of the driver on a Hadoop file system; row data never passes through here.

A commit relies on a rename that fails if the target exists, in one step.
Local files and HDFS have it; an object store that emulates renames does not,
and two writers there need a lock of their own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Storage:
    def __init__(self, spark: SparkSession, root: str):
        jvm = spark._jvm
        self._jvm, self._hadoop = jvm, spark._jsc.hadoopConfiguration()
        self._gateway = spark.sparkContext._gateway
        self.root = root.rstrip("/")
        self._fs = jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(self._hadoop)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name if "/" in name and name.startswith(self.root) else f"{self.root}/{name}")

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        place = self._path(folder)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(place)) if self._fs.exists(place) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_bytes(self, name: str, data: bytes) -> None:
        """A small file, replaced if it exists."""
        stream = self._fs.create(self._path(name), True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Writes a file whole or not at all; raises FileExistsError if there is one of that name."""
        place, beside = self._path(name), self._path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(beside, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._hadoop)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        modes = self._gateway.new_array(rename, 1)
        modes[0] = getattr(rename, "NONE")
        try:
            files.rename(self._fs.makeQualified(beside), self._fs.makeQualified(place), modes)
        except Exception as error:
            self._fs.delete(beside, False)
            if "FileAlreadyExists" in str(error) or self._fs.exists(place):
                raise FileExistsError(name) from error
            raise

    def age(self, name: str) -> float:
        """Seconds since a file or folder was last changed."""
        return self._jvm.java.lang.System.currentTimeMillis() / 1000 - self._fs.getFileStatus(self._path(name)).getModificationTime() / 1000

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
