"""Small files and folders beside tables, on whatever file system Spark is given."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Store:
    """A folder. ``put`` writes a small file under another name first, so a file is there whole or not at all."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder = folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.folder}/{name}" if name else self.folder)

    def names(self, name: str = "") -> list[str]:
        """What lies in a folder; nothing if there is none."""
        at = self._at(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def put(self, name: str, value: dict) -> None:
        """Refuses to replace a file: of two writers of one name, one fails."""
        part = self._at(f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}")
        out = self._fs.create(part, False)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        if self._fs.exists(self._at(name)) or not self._fs.rename(part, self._at(name)):
            self._fs.delete(part, False)
            raise FileExistsError(name)

    def get(self, name: str) -> dict:
        stream = self._fs.open(self._at(name))
        try:
            return json.loads(self._text.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)
