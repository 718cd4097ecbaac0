"""Small files and folders in any store that Spark reaches, by Hadoop's file systems."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


class Folder:
    """A folder by its path or URL; plain paths are local ones, as for Python."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/") if "://" in path or path.startswith("file:") else Path(path).resolve().as_uri()
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, name: str = ""):
        target = self._hadoop.Path(f"{self.path}/{name}" if name else self.path)
        return target.getFileSystem(self._conf), target

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def exists(self, name: str = "") -> bool:
        system, target = self._at(name)
        return system.exists(target)

    def read(self, name: str) -> str:
        system, target = self._at(name)
        stream = system.open(target)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        system, target = self._at(name)
        stream = system.create(target, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def move(self, name: str, to: str) -> None:
        """Replace a file by another in one step, as far as the store has such a step."""
        _, source = self._at(name)
        _, target = self._at(to)
        kind = getattr(self._hadoop, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        self._hadoop.FileContext.getFileContext(source.toUri(), self._conf).rename(source, target, how)

    def names(self) -> list[str]:
        system, target = self._at()
        return [status.getPath().getName() for status in system.listStatus(target)] if system.exists(target) else []

    def delete(self, name: str) -> None:
        system, target = self._at(name)
        system.delete(target, True)

    def size(self, name: str = "") -> int:
        system, target = self._at(name)
        return system.getContentSummary(target).getLength() if system.exists(target) else 0
