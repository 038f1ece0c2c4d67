"""Exact search by inner product over vectors that are keyed by distances.

A component x counts as floor(256 x).  Inner products become distances by one
more component: with M the largest norm, a row gets sqrt(M^2 - |x|^2) and a query
0, so |q - x|^2 = |q|^2 + M^2 - 2 q.x, and a higher score is a smaller distance.
Every row has a key and, for each of the key's vantage points, lies within a
range of distances; the triangle inequality then bounds the distance of a query
from all rows of a key, or of a run of rows sorted by distance.  How keys are
made is the operators' business (`Keys`).

Rows are stored as blocks of one key, sorted by distance from its last vantage
point: a block is an annulus of bounded size, cut further into rings.  Queries go
to the lanes of the keys that they may find something in, many in one row, and
each pair of a block of queries and a block of rows is one unit of work: rings
are read nearest first, and a query leaves off when no ring that is left can hold
a better row.  The nearest keys come first; what they give bounds the search of
the rest.  A key with many rows is dealt out over lanes, so no key is a hot spot.

Bounds allow for rounding; scores are exact integers, and those beyond a long
count as the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbloom.llm._io import Scratch, Shared

#: Vectors that vantage points are chosen from, at most.
SAMPLE = 2048
#: Bytes of vectors in a block of rows, or of queries.
BLOCK_BYTES = 2 << 20
#: Rows of a ring.
RING = 256
#: Share of the largest distance by which bounds are loosened.
SLACK = 1e-6
#: Larger components can't be told from infinite ones in the tables' type.
LARGEST = 3.4028234663852886e38
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1

_ROW = "row long, vec_id long, label int, x binary, key int, path array<double>"
_BLOCK = "key int, lane int, n int, ids array<long>, labels array<int>, path array<double>, x binary"
_QUERY = "row long, vec_id long, label int, x binary, near array<int>, low array<long>, high array<long>, best array<long>"
_OFFER = "key int, lane int, rows array<long>, labels array<int>, vectors binary, center array<double>, low array<long>, high array<long>, best array<long>"


@dataclass(frozen=True)
class Space:
    """What all vectors share: components, squared norm of the longest, bytes of a stored number."""

    dims: int
    longest: float
    rows: int

    @property
    def kind(self) -> str:
        return "<f4" if self.longest < float(1 << 46) else "<f8"

    @property
    def slack(self) -> float:
        return SLACK * (2 * np.sqrt(self.longest) + 1)

    @property
    def block(self) -> int:
        return max(1, min(BLOCK_BYTES // (np.dtype(self.kind).itemsize * max(1, self.dims)), 8192))

    def read(self, blobs) -> np.ndarray:
        raw = b"".join(x.as_py() if isinstance(x, pa.Scalar) else x for x in blobs)
        return np.frombuffer(raw, self.kind).reshape(-1, max(1, self.dims)).astype(np.float64)

    def write(self, x: np.ndarray) -> list[bytes]:
        raw, each = x.astype(self.kind).tobytes(), np.dtype(self.kind).itemsize * max(1, self.dims)
        return [raw[i : i + each] for i in range(0, len(raw), each)]

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Rows with the component that makes all norms equal."""
        return np.column_stack([x, np.sqrt(np.maximum(self.longest - (x * x).sum(axis=1), 0))])


def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all a from all b."""
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T), 0))


@dataclass
class Keys:
    """Vantage points, the way from a vector to its key, and what each key holds.

    ``ways[k]`` are the points whose distances bound key k; ``assign`` gives the
    key of each lifted vector and its distances from them.
    """

    points: np.ndarray
    ways: np.ndarray
    count: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    low: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    high: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def assign(self, lifted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def lanes(self) -> np.ndarray:
        """Lanes of each key: more than one only if it holds more than its share; twice the keys in all."""
        share = max(1, -(-int(self.count.sum()) // max(1, len(self.count))))
        return np.maximum(1, -(-self.count // share))

    def reach(self, q: np.ndarray):
        """Least and greatest distance of each query from the rows of each key, and that from its last point."""
        d = between(np.column_stack([q, np.zeros(len(q))]), self.points)
        least, most = np.zeros((len(q), len(self.count))), np.full((len(q), len(self.count)), np.inf)
        for j in range(self.ways.shape[1]):
            own = d[:, self.ways[:, j]]
            least = np.maximum(least, np.maximum(self.low[None, :, j] - own, own - self.high[None, :, j]))
            most = np.minimum(most, own + self.high[None, :, j])
        return least, most, d[:, self.ways[:, -1]]


def usable(rows: DataFrame) -> DataFrame:
    """``rows(vec_id, label, embedding)`` whose vectors have only finite components."""
    v = F.transform("embedding", lambda x: x.cast("double")).alias("embedding")
    return rows.where(F.col("embedding").isNotNull()).select("vec_id", "label", v).where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST)))


def _component(x: Column) -> Column:
    """floor(256 x) as a double; integral already where a long can't hold it."""
    scaled = x * 256
    return F.when(F.abs(scaled) < float(1 << 53), F.floor(F.when(F.abs(scaled) < float(1 << 53), scaled).otherwise(0.0)).cast("double")).otherwise(scaled)


def measure(rows: DataFrame) -> Space:
    """One pass over usable rows."""
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + _component(x) * _component(x))
    got = rows.agg(F.max(F.size("embedding")).alias("d"), F.max(norm).alias("m"), F.count(F.lit(1)).alias("n")).first()
    return Space(got.d or 0, float(got.m or 0), got.n)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Components of a list column; a shorter vector is filled up with zeros."""
    flat, offsets = np.asarray(column.flatten(), np.float64), np.asarray(column.offsets)
    out, each = np.zeros((len(column), max(1, dims))), np.diff(offsets)
    own = np.repeat(np.arange(len(column)), each)
    out[own, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], each)] = np.floor(256 * flat)
    return out


def sample(rows: DataFrame, space: Space) -> np.ndarray:
    """At most SAMPLE distinct lifted vectors, chosen by hash."""
    held = rows.select("embedding", F.xxhash64("vec_id", "embedding").alias("h")).orderBy("h").limit(SAMPLE).select("embedding").toArrow()
    x = _matrix(held.column(0).combine_chunks(), space.dims)
    return np.unique(space.lifted(x), axis=0)


def keyed(rows: DataFrame, space: Space, keys: Keys, scratch: Scratch, name: str) -> tuple[DataFrame, Keys]:
    """The rows with row number, components, key and distances; and what the keys hold."""
    shared = Shared(rows.sparkSession, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = shared.once(lambda x: x), TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo in range(0, batch.num_rows, space.block):
                part = batch.slice(lo, space.block)
                x = _matrix(part.column(2), space.dims)
                key, path = held.assign(space.lifted(x))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(path) + 1, dtype=np.int32) * path.shape[1]), pa.array(path.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(x))), part.column(0), part.column(1), pa.array(space.write(x), pa.binary()), pa.array(key.astype(np.int32)), lists], ["row", "vec_id", "label", "x", "key", "path"])
                at += len(x)

    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), "embedding")
    out = scratch.save(rows.mapInArrow(run, _ROW), name)
    each, n = keys.ways.shape[1], len(keys.ways)
    ends = [f(F.col("path")[j]).alias(f"{x}{j}") for j in range(each) for x, f in (("l", F.min), ("h", F.max))]
    count, low, high = np.zeros(n, np.int64), np.full((n, each), np.inf), np.full((n, each), -np.inf)
    for r in out.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *ends).collect():
        count[r.key] = r.n
        low[r.key], high[r.key] = [r[f"l{j}"] for j in range(each)], [r[f"h{j}"] for j in range(each)]
    return out, replace(keys, count=count, low=low, high=high)


def blocks(rows: DataFrame, space: Space, keys: Keys) -> DataFrame:
    """Rows of a key, sorted by distance from its last point, in blocks of bounded size."""
    lanes = keys.lanes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        made = TaskContext.get().partitionId()

        def block(part: pa.Table) -> pa.RecordBatch:
            nonlocal made
            made += 1
            key = part.column("key")[0].as_py()
            one = lambda c: pa.array([part.column(c).to_pylist()], pa.list_(part.schema.field(c).type))
            values = [pa.array([key], pa.int32()), pa.array([made % int(lanes[key])], pa.int32()), pa.array([part.num_rows], pa.int32()), one("vec_id"), one("label"), one("last"), pa.array([b"".join(part.column("x").to_pylist())], pa.binary())]
            return pa.RecordBatch.from_arrays(values, ["key", "lane", "n", "ids", "labels", "path", "x"])

        def cut(last: bool):
            whole = pa.Table.from_batches(held)
            key = whole.column("key").to_numpy()
            ends = np.append(np.flatnonzero(np.diff(key)) + 1, len(key))
            lo = 0
            for end in ends.tolist():
                while end - lo >= space.block or (lo < end and (last or end < len(key))):
                    hi = min(end, lo + space.block)
                    yield block(whole.slice(lo, hi - lo))
                    lo = hi
            held[:] = whole.slice(lo).combine_chunks().to_batches()

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= space.block:
                yield from cut(False)
        if held:
            yield from cut(True)

    last = F.element_at("path", -1)
    dealt = rows.select("key", last.alias("last"), "row", "vec_id", "label", "x").repartitionByRange("key", "last", "row").sortWithinPartitions("key", "last", "row")
    return dealt.mapInArrow(run, _BLOCK)


def queries(rows: DataFrame, space: Space, keys: Keys, first: int) -> DataFrame:
    """Keyed rows as queries: ``near`` has the ``first`` keys that may hold the nearest rows; one open window."""
    shared = Shared(rows.sparkSession, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.once(lambda x: x)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                least, _, center = held.reach(space.read(part.column(3)))
                least[:, held.count == 0] = np.inf
                order = np.lexsort((np.broadcast_to(np.arange(least.shape[1]), least.shape), center, least), axis=1)[:, :first]
                near = [[int(k) for k in ks if held.count[k]] for ks in order]
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near, pa.list_(pa.int32())), *(pa.array([[v]] * n, pa.list_(pa.int64())) for v in (_LOW, _HIGH, _LOW))], ["row", "vec_id", "label", "x", "near", "low", "high", "best"])

    return rows.select("row", "vec_id", "label", "x").mapInArrow(run, _QUERY)


def _radius(norm: np.ndarray, score: np.ndarray, space: Space) -> np.ndarray:
    """Distances at which queries of squared norms ``norm`` have these scores."""
    return np.sqrt(np.maximum(norm[:, None] + space.longest - 2 * score, 0))


def _offers(space: Space, shared: Shared, lanes: np.ndarray, nearest: bool):
    """Queries to the keys that may hold rows inside their windows: the near ones, or all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.once(lambda x: x)
        for batch in batches:
            for lo in range(0, batch.num_rows, space.block):
                part = batch.slice(lo, space.block)
                x = space.read(part.column(3))
                low, high, best = (np.array(part.column(c).to_pylist(), np.int64).reshape(len(x), -1) for c in (5, 6, 7))
                least, most, center = keys.reach(x)
                norm = (x * x).sum(axis=1)
                floor = np.maximum(low, best)
                far = np.where((floor == _LOW) | (floor == _HIGH), np.inf, _radius(norm, floor.astype(np.float64), space))
                close = np.where(high == _HIGH, -np.inf, _radius(norm, high.astype(np.float64), space))
                open_ = low <= high
                want = np.zeros(least.shape, bool)
                for i in range(low.shape[1]):
                    want |= (least <= far[:, i, None] + space.slack) & (most >= close[:, i, None] - space.slack) & open_[:, i, None]
                near = np.zeros(least.shape, bool)
                for k, ks in enumerate(part.column(4).to_pylist()):
                    near[k, ks] = True
                want &= (near if nearest else ~near) & (keys.count > 0)[None, :]
                rows, labels, blobs = part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist()
                flat = lambda v, own: v[own].ravel().tolist()
                for key in np.flatnonzero(want.any(axis=0)).tolist():
                    own = np.flatnonzero(want[:, key])
                    offer = {"rows": [rows[i] for i in own], "labels": [labels[i] for i in own], "vectors": b"".join([blobs[i] for i in own]), "center": center[own, key].tolist(), "low": flat(low, own), "high": flat(high, own), "best": flat(best, own)}
                    for lane in range(int(lanes[key])):
                        yield pa.RecordBatch.from_pylist([{"key": key, "lane": lane, **offer}], OFFER)

    return run


OFFER = pa.schema(
    [("key", pa.int32()), ("lane", pa.int32()), ("rows", pa.list_(pa.int64())), ("labels", pa.list_(pa.int32())), ("vectors", pa.binary()), ("center", pa.list_(pa.float64())), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64())), ("best", pa.list_(pa.int64()))]
)


def products(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products: longs, or Python integers within a long's range where doubles are not exact."""
    if exact:
        return (q @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in r] for r in m], object).reshape(m.shape)
    return np.clip(whole(q) @ whole(x).T, _LOW, _HIGH)


def _searched(space: Space, k: int, labels: int):
    """(row, vec_id, score): the k best rows of each window, from pairs of blocks.

    ``labels`` is 1 for rows of the query's label, -1 for rows of another, 0 for all.
    """

    def pair(r: dict, ids: pa.Array):
        x, q = space.read([r["x"]]), space.read([r["vectors"]])
        n, m = len(x), len(q)
        norm = (q * q).sum(axis=1)
        limit = min(int(np.sqrt(space.longest) * np.sqrt(norm.max(initial=0))) + 2, _HIGH + 1)
        exact = limit < 1 << 48
        # one number for score and place: equal scores by smaller id, without an id last
        named = np.array([v is None for v in r["ids"]]), np.array([v or 0 for v in r["ids"]], np.int64)
        place = np.empty(n, np.int64)
        place[np.lexsort((named[1], named[0]))] = np.arange(n - 1, -1, -1)
        kind = np.int64 if exact else object
        low, high, best = (np.array(r[c], np.int64).reshape(m, -1) for c in ("low", "high", "best"))
        wide = low.shape[1]
        floor, top = (np.clip(v.astype(object), -limit, limit).astype(kind) for v in (np.maximum(low, best), high))
        top = np.where(high < low, -limit - 1, top)
        floor_c, top_c, nothing = floor * n, top * n + (n - 1), -(limit + 1) * n
        held = np.full((m, wide, k), nothing, kind)
        center, dist = np.array(r["center"]), np.array(r["path"])
        starts = np.arange(0, n, RING)
        near, far = dist[starts], dist[np.minimum(starts + RING, n) - 1]
        least = np.maximum(np.maximum(near[None, :] - center[:, None], center[:, None] - far[None, :]), 0)
        most = center[:, None] + far[None, :]
        order = np.argsort(least, axis=1, kind="stable")
        inner = np.where(high == _HIGH, -np.inf, _radius(norm, high.astype(np.float64), space))
        own, theirs = np.array([-1 if v is None else v for v in r["labels_q"]]), np.array([-1 if v is None else v for v in r["labels"]])
        for t in range(len(starts)):
            ring = order[:, t]
            # what a row must score now, in each window
            now = np.maximum(floor, held[:, :, 0] // n)
            reach = np.where((now <= -limit) | (now >= _HIGH), np.inf, _radius(norm, now.astype(np.float64), space))
            at = np.arange(m)
            ok = ((least[at, ring][:, None] <= reach + space.slack) & (most[at, ring][:, None] >= inner - space.slack) & (top >= now)).any(axis=1)
            for s in np.unique(ring[ok]).tolist():
                sub = np.flatnonzero(ok & (ring == s))
                rows = slice(s * RING, min(n, s * RING + RING))
                c = products(q[sub], x[rows], exact) * n + place[rows][None, :]
                if labels:
                    c = np.where((own[sub][:, None] == theirs[rows][None, :]) == (labels > 0), c, nothing)
                for i in range(wide):
                    fits = np.where((c >= floor_c[sub, i, None]) & (c <= top_c[sub, i, None]), c, nothing)
                    some = np.flatnonzero((fits > held[sub, i, :1]).any(axis=1))
                    if len(some):
                        both = np.concatenate([held[sub[some], i], fits[some]], axis=1)
                        both = np.sort(both, axis=1) if kind is object else np.partition(both, both.shape[1] - k, axis=1)
                        held[sub[some], i] = np.sort(both[:, -k:], axis=1)
        whose = np.repeat(np.arange(m), wide * k)
        flat = held.reshape(-1)
        keep = flat > nothing
        found = sorted(set(zip(whose[keep].tolist(), flat[keep].tolist(), strict=True)))
        back = np.empty(n, np.int64)
        back[place] = np.arange(n)
        rows = [r["rows"][w] for w, _ in found]
        return rows, ids.take(pa.array([int(back[c % n]) for _, c in found], pa.int64())), [int(c // n) for _, c in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["ids", "labels", "path", "x", "rows", "labels_q", "vectors", "center", "low", "high", "best"]
        for batch in batches:
            for k_ in range(batch.num_rows):
                one = batch.slice(k_, 1)
                r = {c: one.column(j)[0].as_py() for j, c in enumerate(names)}
                rows, ids, scores = pair(r, one.column(0).flatten())
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), ids.cast(pa.int64()), pa.array(scores, pa.int64())], ["row", "vec_id", "score"])

    return run


def _round(asked: DataFrame, stored: DataFrame, space: Space, keys: Keys, k: int, labels: int, nearest: bool) -> DataFrame:
    shared = Shared(asked.sparkSession, keys)
    offers = asked.mapInArrow(_offers(space, shared, keys.lanes(), nearest), _OFFER).withColumnRenamed("labels", "labels_q")
    pairs = stored.join(offers, ["key", "lane"]).select("ids", "labels", "path", "x", "rows", "labels_q", "vectors", "center", F.col("low"), F.col("high"), F.col("best"))
    return pairs.mapInArrow(_searched(space, k, labels), "row long, vec_id long, score long")


def best(found: DataFrame, k: int, *by: str) -> DataFrame:
    """The k highest scores of each group, numbered in ``rank``; equal ones by smaller vec_id."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(asked: DataFrame, stored: DataFrame, space: Space, keys: Keys, k: int, scratch: Scratch, name: str, labels: int = 0) -> DataFrame:
    """(row, vec_id, score) with at least the k best rows of each query's windows.

    ``asked`` as `queries` makes it and ``stored`` as `blocks` does, both written
    tables.  The nearest keys are searched first; their k-th scores bound the
    search of all others.
    """
    first = scratch.save(_round(asked, stored, space, keys, k, labels, True), f"{name}-near")
    windows = asked.select("row", F.posexplode(F.arrays_zip("low", "high")).alias("i", "w"))
    inside = first.join(windows, "row").where("score >= w.low and score <= w.high")
    kth = best(inside, k, "row", "i").where(F.col("rank") == k).select("row", "i", F.col("score").alias("kth"))
    bounds = windows.join(kth, ["row", "i"], "left").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("kth", F.lit(_LOW)).alias("kth")))).alias("b"))
    known = asked.drop("best").join(bounds, "row").withColumn("best", F.col("b.kth")).select(*asked.columns)
    rest = scratch.save(_round(known, stored, space, keys, k, labels, False), f"{name}-rest")
    return first.unionByName(rest)


def without_own(found: DataFrame, k: int) -> DataFrame:
    """The k best of ``found(row, own_id, own_score, vec_id, score)`` besides the query's own row.

    ``found`` has the k + 1 best of each query.  Its own row, if there, is one of
    those with its id and score; which of equal ones goes makes no difference.
    """
    mine = F.col("vec_id").eqNullSafe(F.col("own_id")) & (F.col("score") == F.col("own_score"))
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    copy = F.row_number().over(Window.partitionBy("row", mine).orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    rest = best(found, k + 1, "row").drop("rank").withColumn("_mine", mine).withColumn("_copy", copy).where(~F.col("_mine") | (F.col("_copy") > 1))
    return rest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_mine", "_copy")


def own_scores(asked: DataFrame, space: Space) -> DataFrame:
    """(row, own_id, own_score) of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, space.block):
                part = batch.slice(lo, space.block)
                scores = [min(sum(int(v) ** 2 for v in r), _HIGH) for r in space.read(part.column(2))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores, pa.int64())], ["row", "own_id", "own_score"])

    return asked.select("row", "vec_id", "x").mapInArrow(run, "row long, own_id long, own_score long")


def indexed(spark: SparkSession, rows: DataFrame, fit, scratch: Scratch, name: str):
    """(keyed rows, stored blocks, keys, space) of usable rows; None for no row.

    ``fit`` makes the keys from the sample.
    """
    space = measure(rows)
    if space.rows == 0:
        return None
    held, keys = keyed(rows, space, fit(sample(rows, space)), scratch, f"{name}-rows")
    return held, scratch.save(blocks(held, space, keys), f"{name}-blocks"), keys, space
