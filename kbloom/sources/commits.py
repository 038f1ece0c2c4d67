"""A log of commits: folders that are written hidden and published by one rename.

A rename to a commit's number that never overwrites is the only step that readers
can see; of two writers that want the same number one wins, and the other learns
of it.  What was never published is in a hidden folder and is read by nobody.
The file system's rename must be atomic, as HDFS's and a local disk's are.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Folder:
    """Numbered folders under one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fs = self._at(self.path).getFileSystem(self._conf)

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def numbers(self) -> list[int]:
        """Published numbers in order; an unreadable folder is an error and not an empty log."""
        at = self._at(self.path)
        if not self._fs.exists(at):
            return []
        names = (f.getPath().getName() for f in self._fs.listStatus(at) if f.isDirectory())
        return sorted(int(n) for n in names if n.isdigit())

    def folder(self, number: int) -> str:
        return f"{self.path}/{number:012d}"

    def hidden(self) -> str:
        """A new hidden folder to write to."""
        return f"{self.path}/_staged-{uuid.uuid4().hex}"

    def publish(self, hidden: str, number: int) -> bool:
        """Give a hidden folder its number, unless that is taken."""
        fs = self._jvm.org.apache.hadoop.fs
        files = fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        no_options = self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
        try:
            files.rename(self._at(hidden), self._at(self.folder(number)), no_options)
        except Py4JJavaError as failed:
            if "AlreadyExists" in failed.java_exception.getClass().getName() or self._fs.exists(self._at(self.folder(number))):
                return False
            raise
        return True

    def delete(self, folder: str) -> None:
        self._fs.delete(self._at(folder), True)

    def read(self, schema: str, numbers: list[int]) -> DataFrame:
        if not numbers:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self.folder(n) for n in numbers])
