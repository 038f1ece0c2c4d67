"""Sharding by size-tiered compaction with an atomically committed manifest.

Arrivals are appended as runs of small immutable shards, a folder each.  Runs
whose shards are of similar size form a tier; a tier with ``fan_in`` open runs
or more is merged into one run of larger shards, up to the target size.  Every
append and every merge is a new version of the manifest, a table of live runs
written to a hidden folder and published by one rename that never overwrites.
Readers take the newest version, so they never see half a commit; a run is
deleted only when no live version names it.

Sizes are the text bytes that a run holds, counted while it is written, so plans
don't depend on the codec and no written run is read again for them.  The driver
names runs and not shards: there is one for each open arrival and one for each
full merge.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kbloom.llm._io import shared_dir, table

#: Begins the names of the folders that one write deals arrivals to.
ARRIVAL = "_arrival"
MANIFEST = "run string, folder string, tier int, n_shards long, n_rows long, n_bytes long, version long"


@dataclass(frozen=True)
class Tiers:
    """Tier k holds runs of shards of ``small * fan_in**k`` bytes up to fan_in times that.

    A run whose shards have half the target or more is full and is not merged again.
    """

    target: int = 128 << 20
    small: int = 1 << 20
    fan_in: int = 4

    def of(self, shard_bytes: float) -> int:
        """The tier of a run with shards of so many bytes."""
        k, most = 0, self.small * self.fan_in
        while most <= shard_bytes and most < self.target:
            k, most = k + 1, most * self.fan_in
        return k

    def goal(self, tier: int) -> int:
        """The size of the shards that a merge of a tier makes."""
        return min(self.target, self.small * self.fan_in ** (tier + 2))


def _counted(rows: DataFrame, *groups) -> tuple[DataFrame, Observation]:
    """``rows`` with rows and text bytes counted by the write itself, also for conditions."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    seen = Observation()
    sums = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")]
    for k, group in enumerate(groups):
        sums += [F.count_if(group).alias(f"n{k}"), F.coalesce(F.sum(F.when(group, size)), F.lit(0)).alias(f"b{k}")]
    return rows.observe(seen, *sums), seen


class Store:
    """A folder of immutable shards of documents under a versioned manifest.

    Null texts count as no bytes; an arrival without rows adds no run but is a
    version.  Repeated rows and further columns are kept as they are.
    """

    def __init__(self, spark: SparkSession, base: str, tiers: Tiers = Tiers()):
        self.spark, self.base, self.tiers = spark, base, tiers
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(base).getFileSystem(self._conf)

    def version(self) -> int:
        """The newest published version; 0 for an empty store."""
        at = self._path(f"{self.base}/manifest")
        if not self._fs.exists(at):
            return 0
        return max((int(s.getPath().getName()[1:]) for s in self._fs.listStatus(at)), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """The live runs of a version, by default the newest."""
        version = self.version() if version is None else version
        if version == 0:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.base}/manifest/v{version:08d}")

    def commit(self, live: DataFrame, version: int) -> int:
        """Publish ``live`` as the given version; raises if it exists already."""
        hidden = f"{self.base}/pending/{uuid.uuid4().hex}"
        live.select("run", "folder", "tier", "n_shards", "n_rows", "n_bytes", F.lit(version).cast("long").alias("version")).coalesce(1).write.parquet(hidden)
        self._fs.mkdirs(self._path(f"{self.base}/manifest"))
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        no_options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        # one rename that doesn't overwrite: atomic, and only one writer wins
        files.rename(self._path(hidden), self._path(f"{self.base}/manifest/v{version:08d}"), no_options)
        return version

    def _run(self, folder: str, n_rows: int, n_bytes: int) -> DataFrame:
        """The manifest's row of a written folder; none if it has no rows."""
        at = self._path(folder)
        shards = sum(f.getPath().getName().startswith("part-") for f in self._fs.listStatus(at)) if n_rows and self._fs.exists(at) else 0
        row = (uuid.uuid4().hex, folder, self.tiers.of(n_bytes / max(shards, 1)), shards, n_rows, n_bytes)
        return self.spark.createDataFrame([row] if n_rows else [], MANIFEST.rsplit(",", 1)[0])

    def _write(self, rows: DataFrame) -> DataFrame:
        """Write rows as a run, and return its row of the manifest."""
        folder = f"{self.base}/data/{uuid.uuid4().hex}"
        counted, seen = _counted(rows)
        counted.write.option("compression", "zstd").parquet(folder)
        return self._run(folder, seen.get["n"], seen.get["b"])

    def append(self, arrivals: DataFrame) -> int:
        """Write arrivals as a run of shards, one for each partition they come in."""
        return self.publish(self._write(arrivals))

    def publish(self, run: DataFrame) -> int:
        version = self.version()
        return self.commit(self.manifest(version).drop("version").unionByName(run), version + 1)

    def compact(self) -> list[str]:
        """Merge the lowest tier that has enough open runs; the folders merged, none if no tier has.

        The tier's shards are read and packed into fewer, larger ones without a
        shuffle.  A merge leaves one run in place of several, so repeated calls end.
        """
        version = self.version()
        live = self.manifest(version).drop("version")
        open_ = F.col("n_bytes") < F.col("n_shards") * (self.tiers.target // 2)
        due = live.where(open_).groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shards").alias("s"), F.sum("n_bytes").alias("b"), F.collect_list("folder").alias("folders")).where(F.col("n") >= self.tiers.fan_in).orderBy("tier").first()
        if due is None:
            return []
        shards = max(1, min(due["b"] // self.tiers.goal(due["tier"]), due["s"] // 2))
        made = self._write(self.spark.read.parquet(*due["folders"]).coalesce(shards))
        self.commit(live.where(~open_ | (F.col("tier") != due["tier"])).unionByName(made), version + 1)
        return due["folders"]

    def drop(self, folders: list[str]) -> None:
        """Delete runs that a merge replaced and no reader of an older version needs."""
        for folder in folders:
            self._fs.delete(self._path(folder), True)

    def vacuum(self, grace_seconds: int = 7 * 24 * 3600) -> int:
        """Delete runs that no version in the manifest's newest names, and old versions.

        Runs younger than the grace are spared: another writer may be about to
        commit them, or a reader of an older version may be at work.  Returns the
        number of folders deleted.
        """
        version, gone = self.version(), 0
        used = {r[0] for r in self.manifest(version).select("folder").toLocalIterator()}
        latest = (time.time() - grace_seconds) * 1000
        waiting = [(s, 0) for s in self._fs.listStatus(self._path(f"{self.base}/data"))]
        while waiting:
            status, depth = waiting.pop()
            folder = status.getPath().toString()
            if not status.isDirectory() or any(self._same(folder, u) for u in used):
                continue
            inside = [s for s in self._fs.listStatus(status.getPath()) if s.isDirectory() and s.getPath().getName().startswith(ARRIVAL)]
            if inside and depth == 0:
                waiting += [(s, 1) for s in inside]
            elif status.getModificationTime() <= latest:
                self._fs.delete(status.getPath(), True)
                gone += 1
        for old in self._fs.listStatus(self._path(f"{self.base}/manifest")):
            if old.getPath().getName() != f"v{version:08d}" and old.getModificationTime() <= latest:
                self._fs.delete(old.getPath(), True)
        return gone

    def _same(self, a: str, b: str) -> bool:
        return self._fs.makeQualified(self._path(a)).equals(self._fs.makeQualified(self._path(b)))

    def read(self, schema: StructType, version: int | None = None) -> DataFrame:
        """The rows of a version's live runs, with the shard of each row."""
        folders = [r[0] for r in self.manifest(version).select("folder").toLocalIterator()]
        if not folders:
            return self.spark.createDataFrame([], schema).withColumn("shard", F.lit(None).cast("string"))
        return self.spark.read.schema(schema).parquet(*folders).select("*", F.md5("_metadata.file_path").alias("shard"))


ARRIVALS = 4


def build(spark: SparkSession, docs: DataFrame, tiers: Tiers = Tiers(), arrivals: int = ARRIVALS) -> Store:
    """A compacted store of ``docs``, which arrive in so many batches.

    One pass deals the documents to the arrivals' folders; each is then published
    and its tier compacted, as if it had come alone.
    """
    store = Store(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}", tiers)
    batch = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)), F.lit(0))
    counted, seen = _counted(docs, *[batch == k for k in range(arrivals)])
    folder = f"{store.base}/data/{uuid.uuid4().hex}"
    name = ARRIVAL
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    counted.withColumn(name, batch).write.option("compression", "zstd").partitionBy(name).parquet(folder)
    for k in range(arrivals):
        store.publish(store._run(f"{folder}/{name}={k}", seen.get[f"n{k}"], seen.get[f"b{k}"]))
        while replaced := store.compact():
            store.drop(replaced)
    return store


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as read back through the last committed manifest.

    Repeated rows and rows of nulls come back as often as they arrived.
    """
    docs = table(spark, sf_dir, "documents")
    rows = build(spark, docs).read(docs.schema)
    return rows.select("doc_id", "lang", "source", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))


OP7_SQL = """
SELECT doc_id, lang, source, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes, sha256(text) AS text_sha256
FROM documents
"""
