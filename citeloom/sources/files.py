"""Small file operations by the file system of a path, whatever it is."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    """Files below a folder of any store that Spark reads."""

    def __init__(self, spark: SparkSession, folder: str):
        self._jvm, self.folder = spark._jvm, folder.rstrip("/")
        self._fs = self.path().getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self, name: str = "") -> list[tuple[str, int]]:
        """(name, bytes) of what is in a folder, in order of name; nothing where there is no such folder."""
        if not self._fs.exists(self.path(name)):
            return []
        return sorted((s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(self.path(name)))

    def move(self, name: str, to: str) -> None:
        """Fails where ``to`` exists."""
        if self._fs.exists(self.path(to)) or not self._fs.rename(self.path(name), self.path(to)):
            raise FileExistsError(f"{self.folder}/{to}")

    def make(self, name: str = "") -> None:
        self._fs.mkdirs(self.path(name))

    def drop(self, name: str) -> None:
        self._fs.delete(self.path(name), True)

    def text(self, name: str) -> str:
        stream = self._fs.open(self.path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """The whole file or none; fails where there is one."""
        part = f"{name}.{uuid.uuid4().hex[:8]}.tmp"
        stream = self._fs.create(self.path(part), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.move(part, name)
