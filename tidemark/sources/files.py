"""Small files beside the tables, through the file system that Spark uses for their path."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession


class Store:
    """JSON files and folders under a root that any of Spark's file systems holds."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._hadoop = self._jvm.org.apache.hadoop
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def make(self, name: str) -> None:
        self.fs.mkdirs(self._path(name))

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def list(self, name: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self._path(name))) if self.exists(name) else []

    def sizes(self, name: str, suffix: str) -> dict[str, int]:
        """Bytes of the files directly in a folder, by calls for each."""
        return {x.getPath().getName(): x.getLen() for x in self.files(name, suffix)}

    def files(self, name: str, suffix: str):
        """The files directly in a folder, as an array that stays in the JVM: a call for each of them would take longer than most reads."""
        return self.fs.listStatus(self._path(name), self._hadoop.fs.GlobFilter(f"*{suffix}"))

    def bytes(self, name: str) -> int:
        """Bytes of all files in a folder."""
        return self.fs.getContentSummary(self._path(name)).getLength()

    def size(self, name: str) -> int:
        return self.fs.getFileStatus(self._path(name)).getLen() if self.exists(name) else 0

    def read(self, name: str) -> Any:
        stream = self.fs.open(self._path(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, name: str, value: Any) -> None:
        """Readers see the old file or the new one, never a part of either."""
        draft = self._path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(draft, True)
        try:
            stream.write(bytearray(json.dumps(value, ensure_ascii=False).encode()))
        finally:
            stream.close()
        context = self._hadoop.fs.FileContext.getFileContext(self._path(name).toUri(), self._conf) if self._path(name).toUri().getScheme() else self._hadoop.fs.FileContext.getFileContext(self._conf)
        overwrite = self._hadoop.fs.Options.Rename.OVERWRITE
        kinds = self._jvm.java.lang.reflect.Array.newInstance(overwrite.getClass(), 1)
        self._jvm.java.lang.reflect.Array.set(kinds, 0, overwrite)
        context.rename(draft, self._path(name), kinds)

    def drop(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
