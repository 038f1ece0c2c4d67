"""Exact top-k search by inner product over a pivot-distance index.

Pivots are chosen far apart from a bounded sample.  Every row is keyed by its
nearest pivot and its distance from it, and stored as sorted annuli around the
pivot.  A query reads the annuli around its nearest pivots outward from its own
distance; a row outside an annulus' range of distances can't be nearer than the
gap, so a query stops where the gap exceeds its k-th best distance, and asks only
those other pivots that this bound leaves open.  `_vectors` has the search.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbloom.llm import _vectors
from kbloom.llm._io import Scratch, table

#: Pivots, and how many a query asks first.
PIVOTS, FIRST = 64, 4
#: Queries of the registered search: ids divisible by EVERY, with TOP results.
EVERY, TOP = 50, 5

RESULT = "query_id long, rank int, vec_id long, score long"


class Pivots(_vectors.Keys):
    """Keyed by the nearest pivot."""

    def assign(self, lifted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = _vectors.between(lifted, self.points)
        key = d.argmin(axis=1)
        return key, d[np.arange(len(d)), key][:, None]


def fit(points: np.ndarray, many: int = PIVOTS) -> Pivots:
    """Pivots, each the sampled vector farthest from those before; fewer if the sample has fewer."""
    far, chosen = np.full(len(points), np.inf), [0]
    while True:
        far = np.minimum(far, _vectors.between(points, points[chosen[-1:]])[:, 0])
        if len(chosen) == min(many, len(points)) or far.max() <= 0:
            break
        chosen.append(int(far.argmax()))
    return Pivots(points[chosen], np.arange(len(chosen))[:, None])


def top_k(spark: SparkSession, rows: DataFrame, k: int = TOP, every: int = EVERY, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each row whose id is divisible by ``every``.

    ``rows(vec_id, embedding)``.  Null vectors, and vectors with a null or
    non-finite component (or one beyond the range of a float), take no part;
    shorter vectors count as filled up with zeros.  Rows without an id are no
    queries, and as results come last among equal scores.  Only the query's own
    row is left out: a further copy of it is a result, and a repeated query is
    answered once for each row.  An empty table has no result.
    """
    scratch = Scratch(spark, "top-k")
    rows = _vectors.usable(rows.select("vec_id", F.lit(0).alias("label"), "embedding"))
    made = _vectors.indexed(spark, rows, lambda points: fit(points, pivots), scratch, "index")
    if made is None:
        return spark.createDataFrame([], RESULT)
    held, stored, keys, space = made
    asked = scratch.save(_vectors.queries(held.where(F.col("vec_id") % every == 0), space, keys, FIRST), "queries")
    found = _vectors.search(asked, stored, space, keys, k + 1, scratch, "found")
    out = _vectors.without_own(found.join(_vectors.own_scores(asked, space), "row"), k)
    return out.select(F.col("own_id").alias("query_id"), "rank", "vec_id", "score")


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows of every query against all of ``embeddings``."""
    return top_k(spark, table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
WHOLE = "list_transform(embedding, lambda x: floor(256 * x::DOUBLE))"

OP12_SQL = f"""
WITH v AS (SELECT row_number() OVER () AS k, vec_id, {WHOLE} AS v FROM embeddings WHERE {FINITE}),
s AS (SELECT q.k, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.k <> c.k WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= {TOP}
"""
