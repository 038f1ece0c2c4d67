"""Shared-folder tables that cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import time
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one in local mode only."""
    held = spark.conf.get("spark.checkpoint.dir", None)
    if held:
        return held.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _local_dir()


@cache
def _local_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='kbloom-')}"


#: Text that one Arrow batch to a Python worker holds at most, about.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, unless the session bounds them lower.

    Batches of 10,000 rows are as large as their texts; the buffers on both
    sides of the pipe grow with them.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


#: Seconds between two runs of the driver's collector.
COLLECT_S = 1


class Scratch:
    """Parquet tables of one operator call, in a folder of its own."""

    collected = 0.0

    def __init__(self, spark: SparkSession, tag: str):
        small_batches(spark)
        self.spark, self.base = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back; later plans start from the files.

        The plan that made the table is garbage then, and so are its shuffle
        files: the driver's collector is asked to run every few seconds, which
        lets Spark's cleaner delete them now instead of when the heap is full.
        """
        df.write.mode("error").parquet(f"{self.base}/{name}")
        if time.monotonic() - Scratch.collected > COLLECT_S:
            self.spark._jvm.System.gc()
            Scratch.collected = time.monotonic()
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def drop(self, name: str) -> None:
        """Delete a table that no later plan reads."""
        delete(self.spark, f"{self.base}/{name}")

    def clear(self) -> None:
        """Delete all tables, once no plan reads any."""
        delete(self.spark, self.base)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Shared:
    """A broadcast value, and what each Python worker makes of it once."""

    made: dict = {}

    def __init__(self, spark: SparkSession, value):
        small_batches(spark)
        self.key, self.held = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    def once(self, make):
        if self.key not in Shared.made:
            Shared.made.clear()
            Shared.made[self.key] = make(self.held.value)
        return Shared.made[self.key]


def shielded(docs: DataFrame, *reserved: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns of reserved names renamed, and their old names."""
    old = {}
    taken = {c.lower() for c in docs.columns}
    for name in docs.columns:
        if name.lower() in reserved:
            new = f"_kept_{name}"
            while new.lower() in taken:
                new += "_"
            taken.add(new.lower())
            old[new] = name
            docs = docs.withColumnRenamed(name, new)
    return docs, old
