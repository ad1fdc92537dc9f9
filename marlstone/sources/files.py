"""Small metadata files through the Hadoop file system, so that any store Spark reaches will do."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession


class Folder:
    """A folder in whatever store its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._at(name))) if self.exists(name) else []

    def read_bytes(self, name: str) -> bytes:
        stream = self.fs.open(self._at(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def read_json(self, name: str) -> Any:
        return json.loads(self.read_bytes(name))

    def write_json(self, name: str, value: Any) -> None:
        """Written beside and renamed, so that readers see all of it or none."""
        part = self._at(f"{name}.part")
        stream = self.fs.create(part, True)
        stream.write(json.dumps(value, sort_keys=True, indent=1, default=str).encode())
        stream.close()
        self.fs.delete(self._at(name), False)
        if not self.fs.rename(part, self._at(name)):
            raise OSError(f"could not write {name}")

    def insert_json(self, name: str, value: Any) -> bool:
        """Write a file only if no one else has: written beside and renamed without overwriting, which stores that
        rename atomically (HDFS and the like) decide for exactly one of several writers. Whether it was this one."""
        part = f"{name}.{uuid.uuid4().hex}.part"
        stream = self.fs.create(self._at(part), False)
        stream.write(json.dumps(value, sort_keys=True, indent=1, default=str).encode())
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri() if "://" in self.path else self.fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._at(part), self._at(name), none)
            return True
        except Exception as e:
            self.fs.delete(self._at(part), False)
            if not self.exists(name):
                raise OSError(f"could not write {name}") from e
            return False

    def move(self, old: str, new: str) -> bool:
        self.fs.mkdirs(self._at(new).getParent())
        return self.fs.rename(self._at(old), self._at(new))

    def remove(self, name: str) -> None:
        self.fs.delete(self._at(name), True)

    def child(self, name: str) -> str:
        return f"{self.path}/{name}"
