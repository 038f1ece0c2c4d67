"""Streams agree with their batch twins."""

import os

import pytest
from oracle import SF_DIR
from pyspark.sql import functions as F

from kbloom.plans.store_queries import progress_events
from kbloom.streaming import progress

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_json_lines_skip_what_is_broken(spark):
    lines = spark.createDataFrame([('{"run": 1, "kind": "page", "url": "/a"}',), ("",), ("{broken",), ("[]",), ('{"x": 1}',)], "value string")
    assert [(r.run, r.url) for r in progress.ndjson(lines).collect()] == [(1, "/a")]
    back = progress.ndjson(progress.to_ndjson(progress.ndjson(lines)))
    assert back.count() == 1


def test_stateful_fold_equals_the_batch_fold(spark, tmp_path):
    events = progress_events(spark, SF_DIR).where("run < 20")
    for k, part in enumerate([events.where("seq < 300"), events.where("seq >= 300 and seq < 700"), events.where("seq >= 700")]):
        progress.to_ndjson(part).coalesce(1).write.text(str(tmp_path / f"batch-{k}"))
    os.makedirs(tmp_path / "in")
    for k in range(3):
        for name in os.listdir(tmp_path / f"batch-{k}"):
            if name.startswith("part-") and name.endswith(".txt"):
                target = tmp_path / "in" / f"{k}.txt"
                os.rename(tmp_path / f"batch-{k}" / name, target)
                os.utime(target, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = progress.stream_fold(progress.read_events(spark, str(tmp_path / "in"), files_per_trigger=1))
    run = stream.writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    last = spark.table("folded").groupBy("run").agg(F.max_by(F.struct("stage", "completed", "discovered", "fetched", "pages", "n_warnings"), F.struct(F.col("discovered") + F.col("fetched") + F.col("n_warnings"), F.length("completed"))).alias("s")).select("run", "s.*")
    keep = ["run", "discovered", "fetched", "pages", "n_warnings"]
    assert sorted(map(tuple, last.select(keep).collect())) == sorted(map(tuple, progress.batch_fold(events).select(keep).collect()))


def test_windowed_counts(spark, tmp_path):
    rows = spark.read.parquet(f"{SF_DIR}/events.parquet")
    stream = progress.windowed(spark.readStream.schema(rows.schema).parquet(f"{SF_DIR}/events*.parquet".replace("events*", "event[s]")))
    run = stream.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == rows.count()
