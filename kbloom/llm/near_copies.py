"""Near-copies: SimHash candidates, completed to exact Jaccard similarity.

Two texts are near-copies if their sets of 5-word shingles have a Jaccard
similarity of ``LEAST`` = 4/5 at least; classes are the connected components.
SimHash with its pigeonring index (`simhash_dedup`) brings the pairs within two
bits of the fingerprints of the same shingles.  Most pairs of similarity 0.8 lie
farther apart, about ten bits and up to a third of the 64, which no segment
index prunes, so candidates are completed by prefix filtering and none is missed:
under any common order of shingles, sets of that similarity share one among the
first n - ceil(4n/5) + 1 of each.  A candidate is first bounded by the counts of
both sets in hash buckets, half a byte for a shingle or less, of which no pair of
sets shares more than the lesser; what the bound lets through is checked on the
whole sets.  So texts are moved only for pairs that are alike in large parts.

The order puts shingles that are common in a sample of the documents last, so
that running lines seldom lie in a prefix; the sample changes the work and
never the result.  A bitmap of fixed size, of the prefix shingles that occur
twice, leaves out most of the others before they are shuffled; what it lets
through wrongly is a bucket of one.

The first round compares the SimHash pairs, and each document with the smallest
or largest member of its buckets that promises most.  The second round compares
it with the rest of these.  A third compares each with the member of its buckets
that has most links so far, which is the text that the others are copies of, and
the last the members of a bucket pair by pair.  A round takes only pairs that the
rounds before left in different components, so a group of copies costs about one
comparison a member and not one a pair.

Texts that share a shingle and aren't near-copies must be told apart pair by pair.
A bucket of more than ``PAIR_BUCKET`` such members is cut into blocks of about
``BLOCK``, one row each with their sketches, and tasks compare block with block: a
row is moved for each pair of blocks, and one made only for a pair of members that
the sketches let through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbloom.llm import _text, simhash_dedup
from kbloom.llm._graph import components
from kbloom.llm._io import Scratch, Shared, shielded

SHINGLE_WORDS = 5
#: Least similarity, as a fraction.
LEAST = (4, 5)
#: One document in so many is sampled; a shingle in one of ``COMMON`` sampled documents is common.
SAMPLE, COMMON = 64, 1000
#: Bits of the bitmap of repeated shingles; its 32 MB are the same for any input.
BITMAP_BITS = 1 << 28
#: Members of a bucket that are still paired by a join, and members of a block of a larger one.
PAIR_BUCKET, BLOCK = 32, 256
#: A count of a sketch is this or more; it bounds nothing.
FULL = 15
#: Rounds that compare a bucket's members with the one that has most links.
HUB_ROUNDS = 1


def _sets(batch: pa.RecordBatch, width: int):
    """(row, sorted distinct shingle hashes) of each text; short texts are one shingle."""
    for lo, hi, data, offsets in _text.chunks(batch.column(1)):
        data = _text.LOWER[data]
        starts, ends, first = _text.split_words(data, offsets, _text.SPACE_WORDS)
        if len(starts) == 0:
            yield from ((k, np.zeros(0, np.uint64)) for k in range(lo, hi))
            continue
        of = _text.range_hashes(_text.word_hashes(data, starts, ends), _text.FIRST_BASE)
        n = np.diff(first)
        for k in range(hi - lo):
            i = first[k] + np.arange(max(n[k] - width + 1, min(n[k], 1)))
            yield lo + k, np.unique(of(i, i + min(n[k], width)))


def _shingles(width: int):
    """All shingles of the sampled texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, h in _sets(batch, width):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    return run


def _similar(width: int):
    """The pairs (a, b, text_a, text_b) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = (_sets(pa.RecordBatch.from_arrays([batch.column(0), batch.column(k)], ["id", "text"]), width) for k in (2, 3))
            keep = [_enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)) for (_, x), (_, y) in zip(*both, strict=True)]
            found = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(found), batch.column(1).filter(found)], ["a", "b"])

    return run


def _enough(overlap: int, n_a: int, n_b: int) -> bool:
    return overlap * sum(LEAST) >= (n_a + n_b) * LEAST[0]


def _sketch(h: np.ndarray) -> np.ndarray:
    """Counts of a set in hash buckets, half a byte each; a power of two that is no less than the set.

    Fuller buckets hide differences: at eight to a bucket, sets of similarity 0.6
    pass the bound, at one or two many of 0.75 do, and at less than one few.
    """
    buckets = 16
    while buckets < len(h):
        buckets *= 2
    counts = np.minimum(np.bincount((h & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets), FULL).astype(np.uint8)
    return counts[0::2] | counts[1::2] << 4


def _counts(sketches: np.ndarray) -> np.ndarray:
    """The counts of sketches of one size, a row each."""
    return np.stack([sketches & 15, sketches >> 4], axis=-1).reshape(len(sketches), -1)


def _folded(counts: np.ndarray, size: int) -> np.ndarray:
    """Counts in fewer buckets: the low bits of a hash choose its bucket, so halves add up."""
    while counts.shape[1] > size:
        half = counts.shape[1] // 2
        counts = np.minimum(counts[:, :half] + counts[:, half:], FULL)
    return counts


def _most_in_common(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What the set of counts x shares at most with each of those of y, n at any rate."""
    least = np.minimum(x, y)
    return np.where((least >= FULL).any(axis=1), n, np.minimum(n, least.sum(axis=1, dtype=np.int64)))


def _most_common(x: np.ndarray, y: np.ndarray, n: int) -> int:
    """What sets with these sketches share at most, n at any rate."""
    x, y = _counts(x[None]), _counts(y[None])
    size = min(x.shape[1], y.shape[1])
    return int(_most_in_common(_folded(x, size)[0], _folded(y, size), np.array([n]))[0])


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, n_a, n_b, sketch_a, sketch_b) that may be similar enough."""
    for batch in batches:
        keep = []
        for n_a, n_b, x, y in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True):
            most = _most_common(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8), min(n_a, n_b))
            keep.append(_enough(most, n_a, n_b))
        found = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(found), batch.column(1).filter(found)], ["a", "b"])


def _facing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) across two blocks (same, held_a, held_b) that may be similar enough."""
    for batch in batches:
        found = [np.zeros((2, 0), np.int64)]
        for k, same in enumerate(batch.column(0).to_pylist()):
            found.append(_across(_Block(batch.column(1), k), _Block(batch.column(2), k), same))
        a, b = np.concatenate(found, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


class _Block:
    """Members of a bucket, from row k of a column of lists."""

    def __init__(self, lists: pa.ListArray, k: int):
        rows = lists.slice(k, 1).flatten()
        *columns, sketches = rows.flatten()
        self.id, self.n, self.at, self.c = (np.asarray(x).astype(np.int64) for x in columns)
        held = sketches.to_pylist()
        sizes = np.array([len(x) for x in held])
        #: places and counts of the members by the size of the sketch
        self.sketches = [(own := np.flatnonzero(sizes == n), _counts(np.frombuffer(b"".join(held[i] for i in own), np.uint8).reshape(len(own), n))) for n in np.unique(sizes)]


def _across(x: _Block, y: _Block, same: bool) -> np.ndarray:
    """The pairs of members of different components that sizes, places and sketches allow."""
    num, den = LEAST[0], sum(LEAST)
    both = (x.n[:, None] + y.n) * num
    open_ = (np.minimum((x.n - x.at)[:, None], y.n - y.at) * den >= both) & (x.c[:, None] != y.c)
    if same:
        open_ = np.triu(open_, 1)
    out = [np.zeros((2, 0), np.int64)]
    for own, counts in x.sketches:
        for theirs, others in y.sketches:
            tried = open_[np.ix_(own, theirs)]
            if not tried.any():
                continue
            size = min(counts.shape[1], others.shape[1])
            left, right = _folded(counts, size), _folded(others, size)
            for k in np.flatnonzero(tried.any(axis=1)):
                i, at = own[k], np.flatnonzero(tried[k])
                j = theirs[at]
                j = j[_most_in_common(left[k], right[at], np.minimum(x.n[i], y.n[j])) * den >= both[i, j]]
                out.append(np.stack([np.full(len(j), x.id[i]), y.id[j]]))
    return np.concatenate(out, axis=1)


def _repeated(bitmap: Shared):
    """(id, n, at, h) of the prefix shingles that the bitmap has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bitmap.once(_bits)
        for batch in batches:
            lists = batch.column(2)
            h = np.asarray(lists.flatten())
            each = np.diff(np.asarray(lists.offsets))
            own = np.repeat(np.arange(batch.num_rows), each)
            at = np.arange(len(h)) - np.repeat(np.cumsum(each) - each, each)
            place = h & (BITMAP_BITS - 1)
            i = np.flatnonzero(held[place >> 3] >> (place & 7).astype(np.uint8) & 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own[i])), batch.column(1).take(pa.array(own[i])), pa.array(at[i].astype(np.int32)), pa.array(h[i])], ["id", "n", "at", "h"])

    return run


def _bits(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8)


def _bitmap(spark: SparkSession, hashes: DataFrame) -> Shared:
    """Which low bits of ``hashes(h)`` occur; at most BITMAP_BITS / 8 bytes reach the driver."""
    low = F.col("h").bitwiseAND(F.lit(BITMAP_BITS - 1))
    parts = hashes.groupBy(F.floor(low / 32768).alias("k")).agg(F.bitmap_construct_agg(F.pmod(low, F.lit(32768))).alias("bits"))
    out = np.zeros(BITMAP_BITS >> 3, np.uint8)
    for r in parts.toLocalIterator():
        out[int(r.k) * 4096 : (int(r.k) + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return Shared(spark, zlib.compress(out.tobytes(), 1))


def _prefixes(width: int, common: Shared):
    num, den = LEAST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, places = common.once(lambda x: x)
        for batch in batches:
            for part in _parts((k, *_prefix(h, hashes, places, len(h) + num * -len(h) // den + 1)) for k, h in _sets(batch, width)):
                rows, held, rest = zip(*part, strict=True)
                sizes, digests, sketches = zip(*rest, strict=True)
                columns = [batch.column(0).take(pa.array(rows)), pa.array(digests, pa.int64()), pa.array(sizes, pa.int32()), _lists(held), pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "digest", "n", "prefix", "sketch"])

    return run


def _prefix(h: np.ndarray, hashes: np.ndarray, places: np.ndarray, size: int):
    """The first shingles of a set in the common order, and (size, digest, sketch) of the set."""
    digest = xxhash.xxh64_intdigest(h.tobytes())
    ordered = h
    if len(hashes) and len(h):
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        rank = np.where(hashes[at] == h, places[at], -1)
        ordered = h[np.lexsort((h, rank))]
    return ordered[:size] if len(h) else h, (len(h), digest - (1 << 64) if digest >> 63 else digest, _sketch(h).tobytes())


def _parts(rows, limit: int = 1 << 19):
    """Lists of rows that hold about ``limit`` shingles each."""
    part, n = [], 0
    for row in rows:
        part.append(row)
        n += len(row[1])
        if n >= limit or len(part) >= 10_000:
            yield part
            part, n = [], 0
    if part:
        yield part


def _lists(held) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(held).view(np.int64)))


def _common(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of common shingles and their places, rarest first."""
    sample = docs.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0)
    least = max(2, sample.count() // COMMON)
    each = sample.mapInArrow(_shingles(width), "h long")
    rows = each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).toArrow()
    h, n = (rows.column(c).to_numpy() for c in ("h", "n"))
    h = h.view(np.uint64)
    places = np.empty(len(h), np.int64)
    places[np.lexsort((h, n))] = np.arange(len(h))
    order = np.argsort(h)
    return h[order], places[order]


def _reaches(overlap: Column, n_a: Column, n_b: Column) -> Column:
    """Whether sets with so many common shingles are similar enough."""
    return overlap * sum(LEAST) >= (n_a + n_b) * LEAST[0]


def _possible(pairs: DataFrame) -> DataFrame:
    """Distinct (a, b) of pairs whose sizes and places in the bucket allow the similarity."""
    most = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    return pairs.where("a <> b").where(_reaches(most, F.col("n_a"), F.col("n_b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verified(pairs: DataFrame, docs: DataFrame, sketches: DataFrame, width: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; only texts of likely ones are moved."""
    return _checked(_close(pairs, sketches), docs, width, scratch, name)


def _close(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) that their sketches let through."""
    a, b = (sketches.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(_bounded, "a long, b long")


def _crowded(left: DataFrame, sketches: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of ``left(h, id, n, at, c, many)``, the members of large buckets, that sketches let through."""
    of = F.ceil(F.col("many") / BLOCK)
    placed = left.join(sketches.select("id", "sketch"), "id").withColumn("of", of).withColumn("k", F.pmod(F.xxhash64("id"), "of"))
    blocks = placed.groupBy("h", "of", "k").agg(F.collect_list(F.struct("id", "n", "at", "c", "sketch")).alias("held"))
    blocks = scratch.save(blocks, "blocks")
    facing = blocks.select("h", F.col("k").alias("k_a"), F.explode(F.sequence("k", F.col("of") - 1)).alias("k_b"))
    a, b = (blocks.select("h", F.col("k").alias(f"k_{x}"), F.col("held").alias(f"held_{x}")) for x in "ab")
    facing = facing.join(a, ["h", "k_a"]).join(b, ["h", "k_b"]).select((F.col("k_a") == F.col("k_b")).alias("same"), "held_a", "held_b")
    return facing.mapInArrow(_facing, "a long, b long").distinct()


def _checked(close: DataFrame, docs: DataFrame, width: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    close = scratch.save(close, f"{name}-close")
    ends = close.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = scratch.save(docs.join(ends, "id", "left_semi").groupBy("id").agg(F.first("text").alias("text")), f"{name}-texts")
    a, b = (texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    found = close.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(_similar(width), "a long, b long")
    found = scratch.save(found, name)
    scratch.drop(f"{name}-texts")
    return found


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components of ``found(node, component)``."""
    for x in "ab":
        named = found.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
        pairs = pairs.join(named, x, "left").withColumn(f"c_{x}", F.coalesce(f"c_{x}", x))
    return pairs.where("c_a <> c_b")


def _simhash_pairs(docs: DataFrame, nodes: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """(a, b): each node with the smallest one of its SimHash component, which pigeonring links.

    A star and not all links, so a group of copies gives a pair for each member.
    """
    sole = nodes.select(F.col("node").alias("doc_id"))
    fps = scratch.save(simhash_dedup.fingerprints(docs.withColumnRenamed("id", "doc_id"), width).join(sole, "doc_id", "left_semi"), "fingerprints")
    distinct = scratch.save(fps.select("fp").distinct(), "distinct")
    found = components(simhash_dedup.links(distinct, scratch), scratch)
    placed = fps.join(found, fps.fp == found.node, "left").select("doc_id", F.coalesce("component", "fp").alias("c"))
    placed = scratch.save(placed, "placed")
    hubs = placed.groupBy("c").agg(F.min("doc_id").alias("a"))
    return placed.join(hubs, "c").where("doc_id > a").select("a", F.col("doc_id").alias("b"))


def classes(spark: SparkSession, docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, component_id) for the rows of ``docs`` that have a doc_id.

    The component is the smallest doc_id reached.  Texts with equal sets are one
    node, so exact copies cost one row; null texts and texts without a word are
    one node.  doc_ids are taken for distinct: of several texts of one doc_id one
    is compared.
    """
    scratch = Scratch(spark, "near-copies")
    docs = docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), "text")
    common = Shared(spark, _common(docs, width))
    held = scratch.save(docs.mapInArrow(_prefixes(width, common), "id long, digest long, n int, prefix array<long>, sketch binary"), "prefixes")
    keys = scratch.save(held.select("id", "n", "digest"), "keys")
    nodes = scratch.save(keys.groupBy("n", "digest").agg(F.min("id").alias("node")), "nodes")
    sole = scratch.save(held.join(nodes.select(F.col("node").alias("id")).distinct(), "id", "left_semi").select("id", "n", "prefix", "sketch"), "sole")
    scratch.drop("prefixes")
    twice = sole.select(F.explode("prefix").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("h")
    members = scratch.save(sole.select("id", "n", "prefix").mapInArrow(_repeated(_bitmap(spark, twice)), "id long, n int, at int, h long"), "members")
    sketches = scratch.save(sole.select("id", "n", "sketch"), "sketches")
    scratch.drop("sole")
    entry = F.struct("n", "id", "at")
    ends = scratch.save(members.groupBy("h").agg(F.count(F.lit(1)).alias("many"), F.min(entry).alias("low"), F.max(entry).alias("high")).where("many > 1").drop("many"), "ends")
    stars = members.join(ends, "h").select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"), F.explode(F.array("low", "high")).alias("r"))
    stars = scratch.save(_possible(stars.select("a", "n_a", "at_a", F.col("r.id").alias("b"), F.col("r.n").alias("n_b"), F.col("r.at").alias("at_b"))), "stars")
    best = stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    scratch.drop("ends")
    near = Scratch(spark, "near-links")
    tried = scratch.save(best.unionByName(_simhash_pairs(docs, nodes, width, near)).distinct(), "tried")
    near.clear()
    first = _verified(tried, docs, sketches, width, scratch, "first")
    found = components(first, scratch, "first-cc")
    more = scratch.save(_apart(stars, found).select("a", "b").join(tried, ["a", "b"], "left_anti"), "more")
    second = _verified(more, docs, sketches, width, scratch, "second")
    links, tried = first.unionByName(second), tried.select("a", "b").unionByName(stars.select("a", "b"))
    for k in range(HUB_ROUNDS + 1):
        found = components(links, scratch, f"cc-{k}")
        named = members.join(found, members.id == found.node, "left").select("h", "id", "n", "at", F.coalesce("component", "id").alias("c"))
        named = scratch.save(named, f"named-{k}")
        open_ = named.groupBy("h").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("h")
        left = scratch.save(named.join(open_, "h", "left_semi"), f"open-{k}")
        scratch.drop(f"named-{k}")
        if k == HUB_ROUNDS:
            break
        degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
        ranked = left.join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
        hubs = ranked.groupBy("h").agg(F.max_by(F.struct("id", "n", "at", "c"), F.struct("degree", (-F.col("id")).alias("first"))).alias("r"))
        near = left.join(hubs, "h").where("c <> r.c").select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"), F.col("r.id").alias("b"), F.col("r.n").alias("n_b"), F.col("r.at").alias("at_b"))
        near = scratch.save(_possible(near).join(tried, ["a", "b"], "left_anti"), f"hubs-{k}")
        scratch.drop(f"open-{k}")
        links, tried = links.unionByName(_verified(near, docs, sketches, width, scratch, f"hub-links-{k}")), tried.unionByName(near)
    scratch.drop("members")
    sizes = scratch.save(left.groupBy("h").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > PAIR_BUCKET), "crowds")
    few, many = left.join(sizes, "h", "left_anti"), left.join(sizes, "h")
    a, b = (few.select("h", F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "at", "c")]) for x in "ab")
    pairs = _possible(a.join(b, "h").where("c_a < c_b")).join(tried, ["a", "b"], "left_anti")
    pairs = scratch.save(pairs, "pairs")
    across = scratch.save(_crowded(many, sketches, scratch).join(tried, ["a", "b"], "left_anti"), "across")
    scratch.drop(f"open-{HUB_ROUNDS}")
    scratch.drop("blocks")
    third = _checked(_close(pairs, sketches).unionByName(across).distinct(), docs, width, scratch, "third")
    found = components(links.unionByName(third), scratch)
    named = nodes.join(found, nodes.node == found.node, "left").select("n", "digest", F.coalesce("component", nodes.node).alias("component_id"))
    named = scratch.save(named, "classes")
    return keys.join(named, ["n", "digest"]).select(F.col("id").alias("doc_id"), "component_id")


def keep_first(spark: SparkSession, docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with only the smallest doc_id of each class of near-copies.

    Rows that repeat that doc_id, and rows without a doc_id, stay.  Rows of one
    doc_id go together, and only if every text of theirs is in a class with a
    smaller id.  Of null texts and texts without a word one document stays.
    """
    found = classes(spark, docs.select("doc_id", "text"), width)
    gone = found.groupBy("doc_id").agg(F.max("component_id").alias("c")).where("c < doc_id").select(F.col("doc_id").alias("_gone"))
    names = docs.columns
    docs, old = shielded(docs, "_gone")
    return docs.join(gone, docs.doc_id == F.col("_gone"), "left_anti").select(*docs.columns).withColumnsRenamed(old).select(*names)
