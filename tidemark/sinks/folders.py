"""Small files beside the data of a sink, on any Hadoop file system."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Folder:
    """Names, small texts and deletions below one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, below: str = "") -> list[str]:
        """What lies directly below; nothing where there is no such folder."""
        where = self._at(below)
        if not self._fs.exists(where):
            return []
        return sorted(f.getPath().getName() for f in self._fs.listStatus(where))

    def text(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """The whole text under a name that nobody else has taken, or False."""
        target, part = self._at(name), self._at(f".{uuid.uuid4().hex}")
        self._fs.mkdirs(target.getParent())
        stream = self._fs.create(part, False)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        done = not self._fs.exists(target) and self._fs.rename(part, target)
        if not done:
            self._fs.delete(part, False)
        return bool(done)

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)
