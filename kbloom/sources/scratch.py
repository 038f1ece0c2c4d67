"""Tables in the shared checkpoint folder that cut a plan's lineage."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one in local mode only."""
    held = spark.conf.get("spark.checkpoint.dir", None)
    if held:
        return held.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _local_dir()


@cache
def _local_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='kbloom-')}"


#: Text that one Arrow batch to a Python worker holds at most, about.
BATCH_BYTES = 2 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df`` in a session whose Arrow batches are bounded by bytes, unless it bounds them lower.

    Batches of 10,000 pages are as large as their text, and what a worker makes
    of them grows with them.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(key).rstrip("b")) > BATCH_BYTES:
        conf.set(key, f"{BATCH_BYTES}b")
    return df


def cutter(spark: SparkSession, tag: str):
    """A function (df, name) that writes a table and reads it back."""
    base = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"

    def cut(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    return cut


class Tables:
    """Written tables of one call, in a folder of their own; some grow by parts."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.base, self.schemas = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}", {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def add(self, df: DataFrame, name: str, part: int) -> DataFrame:
        """The table with ``df`` as a further part."""
        self.schemas[name] = df.schema
        df.write.parquet(f"{self.base}/{name}/part={part}")
        return self.spark.read.schema(df.schema).parquet(*[f"{self.base}/{name}/part={k}" for k in range(part + 1)])

    def part(self, name: str, part: int) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.base}/{name}/part={part}")

    def clear(self) -> None:
        """Delete all tables, once no plan reads any."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
