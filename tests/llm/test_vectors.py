"""Exact search and hard negatives against plain passes over all rows."""

import numpy as np
import pytest

from kbloom.llm import _vectors, hard_negatives, topk_search
from kbloom.llm._io import Scratch


def whole(v):
    ok = v is not None and all(x is not None and np.isfinite(x) for x in v)
    return [int(np.floor(256 * np.float64(np.float32(x)))) for x in v] if ok else None


def dot(a, b):
    return min(max(sum(x * y for x, y in zip(a, b, strict=False)), -(1 << 63)), (1 << 63) - 1)


def order(scored):
    return sorted(scored, key=lambda r: (-r[1], r[0] is None, r[0] or 0))


def plain_top(rows, k, every):
    held = [(i, whole(v)) for i, _, v in rows if whole(v) is not None]
    out = []
    for n, (q, x) in enumerate(held):
        if q is not None and q % every == 0:
            found = order([(i, dot(x, y)) for m, (i, y) in enumerate(held) if m != n])[:k]
            out += [(q, r + 1, i, s) for r, (i, s) in enumerate(found)]
    return out


def plain_negatives(rows, every, k, most):
    held = [(i, label, whole(v)) for i, label, v in rows if label is not None and whole(v) is not None]
    out = []
    for n, (a, label, x) in enumerate(held):
        if a is None or a % every:
            continue
        scored = [(i, dot(x, y), other == label) for m, (i, other, y) in enumerate(held) if m != n]
        for p, ps in order([r[:2] for r in scored if r[2]])[:k]:
            fits = order([r[:2] for r in scored if not r[2] and 30 * ps <= 100 * r[1] <= 90 * ps])[:most]
            out += [(a, p, r + 1, i, ps, s) for r, (i, s) in enumerate(fits)]
    return out


def key(rows):
    return sorted(map(tuple, rows), key=repr)


def clustered(n, dims, seed, spread=0.15):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, dims))
    own = rng.integers(0, 6, n)
    v = centers[own] + spread * rng.normal(size=(n, dims))
    return [(int(i), int(own[i]) if rng.random() < 0.6 else int(rng.integers(0, 10)), [float(x) for x in v[i].astype(np.float32)]) for i in range(n)]


def odd():
    """Nulls, non-finite and short vectors, repeated rows and ids, ties, zeros, copies."""
    rows = clustered(60, 5, 3)
    same = [0.5, -0.25, 0.125, 0.0, 1.0]
    rows += [(100 + k, k % 3, same) for k in range(40)]
    rows += [(200, 1, same)] * 3 + [(200, 2, [0.1] * 5), (None, 1, same), (None, None, same), (None, 2, [0.3] * 5)]
    rows += [(300, 1, None), (400, 1, [1.0, None, 0.0, 0.0, 0.0]), (500, 1, [float("nan")] * 5), (600, 1, [float("inf")] * 5)]
    rows += [(700, 1, [0.5]), (800, 1, []), (900, None, same), (0, 3, [0.0] * 5), (1000, 3, [-0.001] * 5), (-50, 1, [-1.0, -2.0, 0.0, 0.0, 1.0])]
    return rows


SCHEMA = "vec_id long, label int, embedding array<float>"


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


@pytest.mark.parametrize("rows", [odd(), clustered(400, 3, 1), clustered(300, 24, 2, spread=1.0)], ids=["odd", "clustered", "spread"])
def test_top_k_equals_a_plain_pass(spark, rows):
    got = topk_search.top_k(spark, frame(spark, rows), k=4, every=10, pivots=8)
    assert key(got.collect()) == key(plain_top(rows, 4, 10))


@pytest.mark.parametrize("rows", [odd(), clustered(400, 3, 1), clustered(300, 24, 2, spread=1.0)], ids=["odd", "clustered", "spread"])
def test_hard_negatives_equal_a_plain_pass(spark, rows):
    got = hard_negatives.mine(spark, frame(spark, rows), every=10, k_positive=3, k_negative=4, depth=4)
    assert key(got.collect()) == key(plain_negatives(rows, 10, 3, 4))


def test_small_blocks_and_rings_change_nothing(spark, monkeypatch):
    rows = odd() + clustered(200, 5, 9)
    monkeypatch.setattr(_vectors, "BLOCK_BYTES", 40)
    assert key(topk_search.top_k(spark, frame(spark, rows), k=4, every=10, pivots=8).collect()) == key(plain_top(rows, 4, 10))


@pytest.mark.parametrize("scale", [1e5, 1e7, 1e12, 1e30])
def test_scores_beyond_a_double_are_exact(spark, scale):
    rows = [(i, 0, [float(np.float32(scale * x)) for x in v]) for i, _, v in clustered(40, 3, 5)]
    got = topk_search.top_k(spark, frame(spark, rows), k=4, every=10, pivots=4)
    assert key(got.collect()) == key(plain_top(rows, 4, 10))


def test_nothing_to_search(spark):
    for rows in ([], [(1, 1, None)], [(10, 1, [1.0])]):
        assert topk_search.top_k(spark, frame(spark, rows), every=10).collect() == []
        assert hard_negatives.mine(spark, frame(spark, rows), every=10).collect() == []


def test_far_keys_are_not_asked(spark):
    """In clusters the bounds leave out most pairs of queries and keys; a heavy key has lanes of its own."""
    rows = [(i, label, [float(x / np.linalg.norm(v)) for x in v]) for i, label, v in clustered(3000, 4, 7, spread=0.02)]
    rows += [(5000 + k, 1, [0.5, 0.5, 0.5, 0.5]) for k in range(1500)]
    df = _vectors.usable(frame(spark, rows))
    scratch = Scratch(spark, "test")
    held, stored, keys, space = _vectors.indexed(spark, df, lambda p: topk_search.fit(p, 16), scratch, "i")
    assert keys.count.sum() == len(rows) and keys.lanes().sum() <= 2 * len(keys.count) and keys.lanes().max() > 1
    assert sorted(i for r in stored.collect() for i in r.ids) == sorted(r[0] for r in rows)
    for r in stored.collect():
        assert r.path == sorted(r.path) and r.lane < keys.lanes()[r.key] and r.n <= space.block
    asked = scratch.save(_vectors.queries(held.where("vec_id < 1000 and vec_id % 10 = 0"), space, keys, 2), "q")
    _vectors.search(asked, stored, space, keys, 4, scratch, "s").collect()
    shared = _vectors.Shared(spark, keys)
    near = spark.read.parquet(f"{scratch.base}/s-near")
    kth = _vectors.best(near, 4, "row").where("rank = 4").selectExpr("row", "array(score) AS best")
    asked = asked.drop("best").join(kth, "row").select(*asked.columns)
    offers = asked.mapInArrow(_vectors._offers(space, shared, keys.lanes(), False), _vectors._OFFER).selectExpr("size(rows) AS n").agg({"n": "sum"}).first()[0] or 0
    assert offers < 0.25 * 100 * len(keys.count)


def test_windows_of_scores(spark):
    """Zero and negative positives; a window that ends between two equal scores' ids."""
    unit = lambda x: [x / 256]
    rows = [(0, 1, unit(10)), (1, 1, unit(10)), (2, 1, unit(0)), (3, 1, unit(-4)), (4, 2, unit(9)), (5, 2, unit(9)), (6, 2, unit(3)), (7, 2, unit(10)), (8, 2, unit(2)), (9, 2, unit(0))]
    got = hard_negatives.mine(spark, frame(spark, rows), every=100, k_positive=3, k_negative=2)
    assert key(got.collect()) == key([(0, 1, 1, 4, 100, 90), (0, 1, 2, 5, 100, 90), (0, 2, 1, 9, 0, 0)])
