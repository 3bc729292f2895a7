"""Folders and small files on the storage that Spark writes to."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Storage:
    """What Spark's readers and writers lack: rename, delete, list, and small files that appear as a whole."""

    def __init__(self, spark: SparkSession, root: str):
        hadoop = spark._jvm.org.apache.hadoop
        self.root, self._path = root.rstrip("/"), hadoop.fs.Path
        self._fs = hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._io = hadoop.io.IOUtils

    def __call__(self, name: str):
        return self._path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self(name))

    def names(self, name: str = "") -> list[str]:
        """What a folder holds; nothing if it does not exist."""
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self(name)))

    def delete(self, name: str = "") -> None:
        self._fs.delete(self(name), True)

    def move(self, name: str, to: str) -> bool:
        """Moves a folder or file in one step; false if the target is there already."""
        self._fs.mkdirs(self(to).getParent())
        return not self.exists(to) and bool(self._fs.rename(self(name), self(to)))

    def write_json(self, name: str, value: dict, staged: str) -> bool:
        """A file that appears as a whole, and never changes; false if it is there already."""
        if self.exists(name):
            return False
        out = self._fs.create(self(staged), True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        if self.move(staged, name):
            return True
        self.delete(staged)
        return False

    def read_json(self, name: str) -> dict:
        stream = self._fs.open(self(name))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
