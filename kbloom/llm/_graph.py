"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbloom.llm._io import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``.

    The component is the smallest node reachable.  Each round links every node
    to the minimum of its neighbourhood, first the larger neighbours and then
    the smaller ones, until the edge set is a set of stars.  Minima are grouped
    with map-side aggregation and joined back, so a hub's neighbours are never
    gathered in one row; rounds grow with the logarithm of the graph's size.
    Null ends and self-loops are ignored.
    """
    held = scratch.save(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        f"{name}-0",
    )
    size = stats(held)
    for k in range(1, most_rounds + 1):
        if size[0] == 0:
            break
        both = held.unionByName(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        low = scratch.save(low, f"{name}-{k}-low")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = scratch.save(large, f"{name}-{k}-large")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        down = scratch.save(down, f"{name}-{k}-down")
        small = (
            large.join(down, "a")
            .select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("m").alias("y")), F.struct(F.col("b").alias("x"), F.col("m").alias("y")))).alias("e"))
            .select(F.col("e.x").alias("a"), F.col("e.y").alias("b"))
            .where("a <> b")
            .distinct()
        )
        small = scratch.save(small, f"{name}-{k}")
        now = stats(small)
        for old in (f"{name}-{k - 1}", f"{name}-{k}-low", f"{name}-{k}-large", f"{name}-{k}-down"):
            scratch.drop(old)
        held, before, size = small, size, now
        if now == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return held.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(held.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def stats(edges: DataFrame) -> tuple:
    """Count and an order-free fingerprint of an edge set."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.coalesce(F.sum(h % 1_000_003), F.lit(0))).first())
