"""Small driver-side file steps in whatever file system Spark is set up for."""

from __future__ import annotations

import uuid
from posixpath import basename

from pyspark.sql import SparkSession


class Folder:
    """A folder of Spark's file systems; a path without a scheme lies in the default one."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm = spark.sparkContext._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(path)
        self._system = self._root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _at(self, name: str) -> object:
        return self._jvm.org.apache.hadoop.fs.Path(self._root, name)

    def full(self, name: str) -> str:
        return self._system.makeQualified(self._at(name)).toString()

    def names(self, pattern: str) -> list[str]:
        """Names of the entries that match, in order; none if the folder is not there."""
        found = self._system.globStatus(self._at(pattern)) or []
        return sorted(basename(f.getPath().toUri().getPath()) for f in found)

    def exists(self, name: str) -> bool:
        return self._system.exists(self._at(name))

    def read(self, name: str) -> str:
        stream = self._system.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        """Write a file that appears whole or not at all; one that is there already stays as it is."""
        if self.exists(name):
            return False
        place = self._at(name)
        staged = self._jvm.org.apache.hadoop.fs.Path(place.getParent(), f"_{uuid.uuid4().hex}")
        stream = self._system.create(staged, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self._system.rename(staged, place):
            return True
        self._system.delete(staged, False)
        if not self.exists(name):
            raise OSError(f"could not write {self.full(name)}")
        return False

    def delete(self, name: str) -> None:
        self._system.delete(self._at(name), True)
