"""Progress of crawls: a stateful fold over their events, batch and streaming.

Events are (run, seq, kind, stage, status, url, count, message).  The fold keeps
the stage at work, the stages done, pages found and fetched, the last eight
pages and each warning once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENTS = "run long, seq long, kind string, stage string, status string, url string, count long, message string"
PROGRESS = "run long, stage string, completed string, discovered long, fetched long, pages string, n_warnings long"
HISTORY = 8


def ndjson(lines: DataFrame) -> DataFrame:
    """Events of JSON lines; blank and broken lines are skipped."""
    parsed = F.from_json("value", EVENTS, {"mode": "PERMISSIVE"})
    return lines.where(F.trim("value") != "").select(parsed.alias("e")).where("e.kind is not null").select("e.*")


def to_ndjson(events: DataFrame) -> DataFrame:
    return events.select(F.to_json(F.struct("*")).alias("value"))


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the JSON lines that arrive in a folder."""
    return ndjson(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path))


def batch_fold(events: DataFrame) -> DataFrame:
    """The progress of each run after all its events, by grouped aggregation."""
    stages = events.where("kind = 'stage'").select("run", "stage", "status", "seq")
    started = stages.where("status = 'start'").groupBy("run").agg(F.max_by(F.struct("stage", "seq"), "seq").alias("s"))
    ended = stages.where("status = 'done'").groupBy("run", "stage").agg(F.max("seq").alias("last"), F.min("seq").alias("first"))
    at = started.join(ended, (started.run == ended.run) & (F.col("s.stage") == ended.stage), "left").select(started.run, F.when(F.col("last").isNull() | (F.col("last") < F.col("s.seq")), F.col("s.stage")).alias("stage"))
    done = ended.groupBy("run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "stage"))), lambda x: x["stage"]), "|").alias("completed"))
    sums = events.groupBy("run").agg(F.coalesce(F.sum(F.when(F.col("kind") == "discovered", F.col("count"))), F.lit(0)).alias("discovered"), F.count_if(F.col("kind") == "page").alias("fetched"))
    recent = events.where("kind = 'page'").withColumn("k", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("seq")))).where(F.col("k") <= HISTORY)
    pages = recent.groupBy("run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "url"))), lambda x: x["url"]), "|").alias("pages"))
    warned = events.where("kind = 'warning'").groupBy("run").agg(F.count_distinct("message").alias("n_warnings"))
    return (
        sums.join(at, "run", "left").join(done, "run", "left").join(pages, "run", "left").join(warned, "run", "left")
        .select("run", "stage", F.coalesce("completed", F.lit("")).alias("completed"), "discovered", "fetched", F.coalesce("pages", F.lit("")).alias("pages"), F.coalesce("n_warnings", F.lit(0)).alias("n_warnings"))
    )


def stream_fold(events: DataFrame) -> DataFrame:
    """The progress of each run after every batch that has events of it.

    State is bounded by the stages, eight pages and the distinct warnings.
    """
    state = "stage string, completed string, discovered long, fetched long, pages string, warnings string"

    def step(key: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        stage, completed, discovered, fetched, pages, warnings = held.get if held.exists else (None, "", 0, 0, "", "")
        done, last, said = ([x for x in t.split(sep) if x] for t, sep in ((completed, "|"), (pages, "|"), (warnings, "\n")))
        rows = pd.concat(list(batches)).sort_values("seq")
        for e in rows.itertuples():
            if e.kind == "stage" and e.status == "start":
                stage = e.stage
            elif e.kind == "stage":
                stage = None if stage == e.stage else stage
                if e.stage not in done:
                    done.append(e.stage)
            elif e.kind == "discovered":
                discovered += int(e.count)
            elif e.kind == "page":
                fetched += 1
                last = [e.url, *last][:HISTORY]
            elif e.kind == "warning" and e.message not in said:
                said.append(e.message)
        held.update((stage, "|".join(done), discovered, fetched, "|".join(last), "\n".join(said)))
        yield pd.DataFrame([(key[0], stage, "|".join(done), discovered, fetched, "|".join(last), len(said))], columns=[c.split()[0] for c in PROGRESS.split(", ")])

    return events.groupBy("run").applyInPandasWithState(step, PROGRESS, state, "update", "NoTimeout")


def windowed(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Extension: counts by event time, late rows up to the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
