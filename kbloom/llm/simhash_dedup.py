"""SimHash near-dedup with pigeonring candidate filtering.

A fingerprint's 64 bits are cut into a ring of five segments.  Two fingerprints
at ``MOST_BITS`` = 2 or fewer differing bits have a place on the ring from which
every chain of consecutive segments stays within its proportional budget, so
the chain's first two segments are equal (2 * 2 / 5 < 1), the first three and
four differ by one bit at most, and all five by two.  The two equal segments
are the key of an index with five rotations; the longer chains prune candidates
before the full Hamming check.

A bucket of more than ``PAIR_BUCKET`` distinct fingerprints is refined along the
ring by the chain's next budgets: the third segment joins the key, and since one
bit may differ in it one side is looked up under its 14 values within one bit;
buckets that are still crowded take in the fourth segment under what is left of
that bit.  A bucket of 52 bits that is crowded even then holds fingerprints that
differ in a few bits alone; those meet under the 39 values within one bit of
their last three segments, at most 39 to a value, and are linked to the least.

Components run over fingerprints and get their names at the end, so rows that
repeat a doc_id with another text are told apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbloom.llm import _text
from kbloom.llm._graph import components
from kbloom.llm._io import Scratch, shielded, table

SHINGLE_WORDS = 3
MOST_BITS = 2
SEED = 42
SEGMENTS = 5
PAIR_BUCKET = 32


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: Masks of the ring's segments: 13, 13, 13, 13 and 12 bits.
MASKS = [((1 << min(64, 13 * (i + 1))) - 1) & ~((1 << 13 * i) - 1) for i in range(SEGMENTS)]


def _fingerprints(width: int, marked: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            for lo, hi, data, offsets in _text.chunks(batch.column(1)):
                data = _text.LOWER[data]
                starts, ends, first = _text.split_words(data, offsets, _text.SPACE_WORDS)
                # words of a document joined by one space each
                keep = _text.SPACE_WORDS[data]
                data[~keep] = 0x20
                keep[ends[ends < len(data)]] = True
                upto = np.concatenate([[0], np.cumsum(keep)])
                raw, starts, ends = data[keep].tobytes(), upto[starts], upto[ends]
                n = np.diff(first)
                shingles = np.where(n >= width, n - width + 1, np.minimum(n, 1))
                own = np.repeat(np.arange(hi - lo), shingles)
                i = first[own] + np.arange(len(own)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
                last = i + np.minimum(n[own], width) - 1
                hashes = np.fromiter((digest(raw[s:e], SEED) for s, e in zip(starts[i].tolist(), ends[last].tolist(), strict=True)), np.uint64, len(i))
                out = np.zeros(hi - lo, np.int64)
                full = np.flatnonzero(shingles)
                if len(full):
                    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
                    sums = np.add.reduceat(bits, (np.cumsum(shingles) - shingles)[full], axis=0, dtype=np.int32)
                    over = 2 * sums > shingles[full][:, None]
                    out[full] = np.packbits(over, axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)
                held = [batch.column(0).slice(lo, hi - lo), pa.array(out)]
                if marked:
                    held.append(batch.column(2).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays(held, ["doc_id", "fp", "mark"][: len(held)])

    return run


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): the SimHash of each text; without a word it is zero."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints(width), "doc_id long, fp long")


def _masked(fp: Column, *segments: int) -> Column:
    """The bits of the ring's given segments."""
    mask = 0
    for i in segments:
        mask |= MASKS[i % SEGMENTS]
    return fp.bitwiseAND(F.lit(_signed(mask)))


def _by_turn(turn: Column, value) -> Column:
    """value(i) for each row's turn i."""
    out = F.when(turn == 0, value(0))
    for i in range(1, SEGMENTS):
        out = out.when(turn == i, value(i))
    return out


def _flips(c: Column, *segments: int) -> Column:
    """c and its values with one bit of the given segments changed."""
    bits = [k for k in range(64) if any(MASKS[i % SEGMENTS] >> k & 1 for i in segments)]
    return F.array(c, *[c.bitwiseXOR(F.lit(_signed(1 << k))) for k in bits])


def links(fps: DataFrame, scratch: Scratch, most: int = PAIR_BUCKET) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints ``fps(fp)`` that connect all links."""
    turn, fp = F.col("turn"), F.col("fp")
    ring = F.array(*[F.struct(F.lit(i).alias("turn"), _masked(fp, i, i + 1).alias("key")) for i in range(SEGMENTS)])
    spread = fps.select("fp", F.explode(ring).alias("r")).select("fp", "r.turn", "r.key")
    sizes = scratch.save(spread.groupBy("turn", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    held = scratch.save(spread.join(sizes, ["turn", "key"]), "members")
    small, rest = held.where(F.col("n") <= most), held.where(F.col("n") > most).drop("n")
    out = _pairs(small, small)
    # looked is one side of the pairs, under its own bits; sought is the other, under all values its budget allows
    third = rest.withColumn("bits", _by_turn(turn, lambda i: F.transform(_flips(_masked(fp, i + 2), i + 2), lambda x: F.struct(x.alias("part"), (x != _masked(fp, i + 2)).alias("spent")))))
    sought = third.select("fp", "turn", "key", F.explode("bits").alias("v")).select("fp", "turn", F.col("key").bitwiseOR(F.col("v.part")).alias("key"), "v.spent")
    looked = rest.select("fp", "turn", F.col("key").bitwiseOR(_by_turn(turn, lambda i: _masked(fp, i + 2))).alias("key"))
    for level in (3, 4):
        looked, sought = scratch.save(looked, f"looked-{level}"), scratch.save(sought, f"sought-{level}")
        crowded = scratch.save(looked.groupBy("turn", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).drop("n"), f"crowded-{level}")
        out = out.unionByName(_pairs(looked.join(crowded, ["turn", "key"], "left_anti"), sought))
        looked, sought = looked.join(crowded, ["turn", "key"]), sought.join(crowded, ["turn", "key"])
        if level == 3:
            fourth = _by_turn(turn, lambda i: F.when(F.col("spent"), F.array(_masked(fp, i + 3))).otherwise(_flips(_masked(fp, i + 3), i + 3)))
            sought = sought.select("fp", "turn", F.col("key"), F.explode(fourth).alias("part"), F.col("spent")).select("fp", "turn", F.col("key").bitwiseOR(F.col("part")).alias("key"), "spent")
            looked = looked.select("fp", "turn", F.col("key").bitwiseOR(_by_turn(turn, lambda i: _masked(fp, i + 3))).alias("key"))
    dense = looked.select("turn", "fp").unionByName(sought.select("turn", "fp")).distinct()
    met = dense.select("fp", F.explode(_by_turn(turn, lambda i: _flips(fp, i + 2, i + 3, i + 4))).alias("near")).groupBy("near").agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")
    stars = met.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a <> b")
    return out.unionByName(stars)


def _pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Edges between members of a bucket: chain budgets first, then the Hamming check."""
    a, b = (df.select("turn", "key", F.col("fp").alias(x)) for df, x in ((left, "a"), (right, "b")))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    within = lambda i, n: F.bit_count(_masked(differ, *range(i + 2, i + n))) <= n * MOST_BITS // SEGMENTS
    viable = _by_turn(F.col("turn"), lambda i: within(i, 3) & within(i, 4))
    same = ["turn", "key"]
    return a.join(b, same).where("a <> b").where(viable).where(F.bit_count(differ) <= MOST_BITS).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def classes(spark: SparkSession, docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    Rows with equal fingerprints are one node, so exact copies cost one row; null
    texts and texts without a word share the fingerprint zero.  The component_id
    is the smallest doc_id of the component.  Rows link by fingerprint alone: two
    texts of one doc_id don't link by that id.  Rows without a doc_id take part
    and are never a component's name, which is null if no row of it has an id.
    """
    return _classes(spark, docs.select("doc_id", "text", F.lit(None).cast("long").alias("mark")), width).select("doc_id", "fp", "component_id")


def _classes(spark: SparkSession, docs: DataFrame, width: int) -> DataFrame:
    """`classes` of ``docs(doc_id, text, mark)`` with the column mark passed on."""
    scratch = Scratch(spark, "simhash")
    fps = scratch.save(docs.mapInArrow(_fingerprints(width, True), "doc_id long, fp long, mark long"), "fingerprints")
    nodes = scratch.save(fps.groupBy("fp").agg(F.min("doc_id").alias("id")), "nodes")
    found = components(links(nodes.select("fp"), scratch), scratch)
    placed = scratch.save(nodes.join(found, nodes.fp == found.node, "left").select("fp", "id", F.coalesce("component", "fp").alias("c")), "placed")
    names = placed.groupBy("c").agg(F.min("id").alias("component_id"))
    named = scratch.save(placed.join(names, "c").select("fp", "component_id"), "classes")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id", "mark")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its fingerprint and the smallest doc_id it is linked to."""
    found = classes(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(spark: SparkSession, docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with only the smallest doc_id of each near-duplicate class.

    Rows are judged text by text: of a doc_id with several texts those go whose
    class has a smaller id.  Rows that repeat the smallest doc_id, and rows
    without a doc_id, stay.
    """
    mark = F.xxhash64("text")
    found = _classes(spark, docs.select("doc_id", "text", mark.alias("mark")), width)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    names = docs.columns
    docs, old = shielded(docs, "_id", "_mark")
    kept = docs.join(gone, (docs.doc_id == F.col("_id")) & (F.xxhash64(docs.text) == F.col("_mark")), "left_anti")
    return kept.select(*docs.columns).withColumnsRenamed(old).select(*names)
