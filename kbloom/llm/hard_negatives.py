"""Hard-negative mining over a vantage-point tree.

The tree is fitted on a bounded sample of norm-augmented vectors: a vantage point
splits its part at the median distance, ``DEPTH`` times over.  Every row goes down
to a leaf, and for each vantage point on the way the leaf knows the range of its
rows' distances.  With equal norms a score is a distance, so the window of scores
that makes a negative hard is an annulus around the anchor: a leaf, or a ring of
rows within one, is left out if the triangle inequality puts it inside or outside
the annulus.  What is left is read nearest first from the inner edge, until k rows
of another label are found and nothing nearer can be left.  `_vectors` has the
search; positives are found with the same tree.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbloom.llm import _vectors
from kbloom.llm._io import Scratch, table
from kbloom.llm.topk_search import FINITE, WHOLE

#: Splits from the root to a leaf, and how many leaves an anchor asks first.
DEPTH, FIRST = 6, 4
#: Anchors are ids divisible by EVERY; positives of each, negatives of each pair.
EVERY, POSITIVES, NEGATIVES = 100, 5, 10
#: A negative scores between these hundredths of the positive.
WINDOW = (30, 90)

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass
class Tree(_vectors.Keys):
    """Keyed by the leaf of a complete binary tree; node i has the children 2i + 1 and 2i + 2."""

    medians: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def assign(self, lifted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d, at = _vectors.between(lifted, self.points), np.zeros(len(lifted), np.int64)
        path, own = np.zeros((len(lifted), self.ways.shape[1])), np.arange(len(lifted))
        for j in range(path.shape[1]):
            path[:, j] = d[own, at]
            at = 2 * at + 1 + (path[:, j] > self.medians[at])
        return at - len(self.points), path


def fit(points: np.ndarray, depth: int = DEPTH) -> Tree:
    """A tree over the sample; a part's vantage point is its vector farthest from the part's mean."""
    many = (1 << depth) - 1
    at, medians, parts = np.zeros((many, points.shape[1])), np.zeros(many), {0: points}
    for node in range(many):
        part = parts.pop(node)
        whole = part if len(part) else points
        at[node] = whole[_vectors.between(whole, whole.mean(axis=0, keepdims=True))[:, 0].argmax()]
        d = _vectors.between(part, at[node : node + 1])[:, 0]
        medians[node] = np.median(d) if len(d) else 0
        parts[2 * node + 1], parts[2 * node + 2] = part[d <= medians[node]], part[d > medians[node]]
    leaf = np.arange(many, 2 * many + 1)
    ways = []
    for _ in range(depth):
        leaf = (leaf - 1) // 2
        ways.append(leaf)
    return Tree(at, np.stack(ways[::-1], axis=1), medians=medians)


def _times(column: str, by: int):
    return F.col(column).cast("decimal(20,0)") * F.lit(by).cast("decimal(3,0)")


def positives(asked: DataFrame, stored: DataFrame, space: _vectors.Space, keys: Tree, k: int, scratch: Scratch) -> DataFrame:
    """(row, anchor_id, place, positive_id, positive_score): the k best other rows of the anchor's label."""
    found = _vectors.search(asked, stored, space, keys, k + 1, scratch, "same", labels=1)
    out = _vectors.without_own(found.join(_vectors.own_scores(asked, space), "row"), k)
    return out.select("row", F.col("own_id").alias("anchor_id"), F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))


def mine(spark: SparkSession, rows: DataFrame, every: int = EVERY, k_positive: int = POSITIVES, k_negative: int = NEGATIVES, depth: int = DEPTH) -> DataFrame:
    """Hard negatives of each anchor and positive of ``rows(vec_id, label, embedding)``.

    Rows with a null label, a null vector, or a null or non-finite component (or
    one beyond the range of a float) take no part; shorter vectors count as filled
    up with zeros.  Rows without an id are no anchors, and come last among equal
    scores.  Copies of a row are rows of their own: a copy of the anchor can be
    its positive, and a repeated anchor is answered once for each row.  A positive
    of negative score has no negative, one of score 0 those of score 0.  Anchors
    without positives, and pairs without negatives, have no row.
    """
    scratch = Scratch(spark, "negatives")
    rows = _vectors.usable(rows.where("label is not null"))
    made = _vectors.indexed(spark, rows, lambda points: fit(points, depth), scratch, "tree")
    if made is None:
        return spark.createDataFrame([], RESULT)
    held, stored, keys, space = made
    asked = scratch.save(_vectors.queries(held.where(F.col("vec_id") % every == 0), space, keys, FIRST), "anchors")
    pairs = scratch.save(positives(asked, stored, space, keys, k_positive, scratch), "positives")
    low, high = F.ceil(_times("positive_score", WINDOW[0]) / 100), F.floor(_times("positive_score", WINDOW[1]) / 100)
    windows = pairs.where("positive_score >= 0").select("row", F.struct(F.col("positive_score").alias("s"), low.cast("long").alias("low"), high.cast("long").alias("high")).alias("w"))
    # one window for each distinct score, filled up to as many as there are positives with empty ones
    windows = windows.groupBy("row").agg(F.array_sort(F.collect_set("w")).alias("w"))
    empty = F.array_repeat(F.struct(F.lit(0).cast("long").alias("s"), F.lit(1).cast("long").alias("low"), F.lit(0).cast("long").alias("high")), k_positive)
    windows = windows.withColumn("w", F.slice(F.concat("w", empty), 1, k_positive))
    ready = asked.join(windows, "row").select("row", "vec_id", "label", "x", "near", F.col("w.low").alias("low"), F.col("w.high").alias("high"), F.transform("w", lambda _: F.lit(-(1 << 63))).alias("best"))
    ready = scratch.save(ready, "windows")
    found = _vectors.search(ready, stored, space, keys, k_negative, scratch, "other", labels=-1)
    least, most = (_times("positive_score", by) for by in WINDOW)
    fits = found.join(pairs, "row").where((_times("score", 100) >= least) & (_times("score", 100) <= most))
    out = _vectors.best(fits, k_negative, "row", "place")
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def relabelled(rows: DataFrame) -> DataFrame:
    """Where vec_id is divisible by 7, label becomes (label + 1) % 10."""
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor of ``embeddings``, against all rows."""
    return mine(spark, relabelled(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")))


OP13_SQL = f"""
WITH v AS (SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {WHOLE} AS v FROM embeddings WHERE label IS NOT NULL AND {FINITE}),
s AS (SELECT a.k, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.k <> b.k WHERE a.vec_id % {EVERY} = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id NULLS LAST) AS place FROM s WHERE same QUALIFY place <= {POSITIVES}),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.k, p.place ORDER BY s.score DESC, s.vec_id NULLS LAST)::INTEGER AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
      FROM p JOIN s ON p.k = s.k AND NOT s.same AND {WINDOW[0]} * p.score <= 100 * s.score AND 100 * s.score <= {WINDOW[1]} * p.score)
SELECT * FROM n WHERE rank <= {NEGATIVES}
"""
