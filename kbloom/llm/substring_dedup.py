"""Substring dedup by relative Lempel-Ziv factors over indexed reference blocks.

A document's reference is every document with a smaller id.  The reference is
cut into content-defined blocks: the run of consecutive windows that share one
minimiser (the least hash of ``ANCHOR_WORDS`` consecutive words inside the
window).  Equal passages are cut into equal blocks wherever they stand, so an
index by minimiser finds every block that can hold a match, and a document is
factored against all of them at once:

1. greedy step: a block that equals a block of a smaller document becomes part
   of a factor as a whole;
2. boundary step: a block that shares its minimiser with other blocks but is
   not a copy as a whole stands at the edge of a factor; there each window is
   looked up on its own.

Joined factors are the maximal runs of words covered by windows that start in a
smaller document.  Words themselves are not compared: blocks and windows are
equal if their minimisers and their own hashes are, two independent 64-bit
hashes.  Rows are told apart by doc_id and a 64-bit hash of the text.  Grouping is by minimum and maximum id with map-side aggregation; no
group is gathered, and the work is linear in the words of the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbloom.llm import _text
from kbloom.llm._io import Scratch, shielded, table

WINDOW_WORDS = 50
ANCHOR_WORDS = 12
#: A block's window count and its start share one number.
SHIFT = 16
#: Blocks of periodic text are cut after so many windows.
LONGEST_BLOCK = 4096

_BLOCKS = "doc_id long, text_key long, loc long, anchor long, block long"
_WINDOWS = "doc_id long, text_key long, start long, anchor long, win long"


def _blocks(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            for lo, hi, data, offsets in _text.chunks(batch.column(1)):
                starts, ends, first = _text.split_words(data, offsets, _text.SPACE_WORDS)
                if len(starts) < window:
                    continue
                words = _text.word_hashes(data, starts, ends)
                at = np.arange(len(words) - k + 1)
                least = _text.sliding_min(_text.range_hashes(words, _text.FIRST_BASE)(at, at + k), window - k + 1)
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(least)]
                i = np.flatnonzero(np.arange(len(least)) + window <= first[1:][doc])
                if len(i) == 0:
                    continue
                least, doc = least[i], doc[i]
                new = np.ones(len(i), bool)
                new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
                begin = np.flatnonzero(new)
                if np.diff(np.append(begin, len(i))).max() > LONGEST_BLOCK:
                    since = np.arange(len(i)) - np.repeat(begin, np.diff(np.append(begin, len(i))))
                    begin = np.flatnonzero(new | (since % LONGEST_BLOCK == 0))
                length = np.diff(np.append(begin, len(i)))
                block = _text.range_hashes(words, _text.SECOND_BASE)(i[begin], i[begin] + length + window - 1)
                own = doc[begin]
                loc = ((i[begin] - first[own]) << SHIFT) | length
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][own]), pa.array(keys[lo:hi][own]), pa.array(loc), pa.array(least[begin].view(np.int64)), pa.array(block.view(np.int64))], ["doc_id", "text_key", "loc", "anchor", "block"])

    return run


def _windows(window: int):
    """Hashes of the windows of the blocks that `asked` names in each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, asked = np.asarray(batch.column(0)), np.asarray(batch.column(2)), batch.column(3)
            for lo, hi, data, offsets in _text.chunks(batch.column(1)):
                starts, ends, first = _text.split_words(data, offsets, _text.SPACE_WORDS)
                hashed = _text.range_hashes(_text.word_hashes(data, starts, ends), _text.SECOND_BASE)
                part = asked.slice(lo, hi - lo)
                each = np.diff(np.asarray(part.offsets))
                flat = part.flatten()
                loc, anchor = np.asarray(flat.field(0)), np.asarray(flat.field(1))
                own = np.repeat(np.arange(hi - lo), each)
                n = loc & ((1 << SHIFT) - 1)
                back = np.repeat(np.arange(len(n)), n)
                start = (loc >> SHIFT)[back] + np.arange(len(back)) - np.repeat(np.cumsum(n) - n, n)
                there = start + first[own[back]]
                rows = own[back]
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][rows]), pa.array(keys[lo:hi][rows]), pa.array(start), pa.array(anchor[back]), pa.array(hashed(there, there + window).view(np.int64))], ["doc_id", "text_key", "start", "anchor", "win"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the hash that tells texts of one doc_id apart."""
    return docs.withColumn("text_key", F.xxhash64("text"))


def duplicate_spans(docs: DataFrame, scratch: Scratch, window: int = WINDOW_WORDS, k: int = ANCHOR_WORDS) -> DataFrame:
    """(doc_id, text_key, start, stop): word ranges covered by smaller documents' windows.

    ``docs`` holds doc_id and text.  Ranges of one document may touch or overlap;
    text_key says which of its texts they are of, should a doc_id have several.
    """
    texts = _keyed(docs.select("doc_id", "text").where("doc_id is not null and text is not null"))
    blocks = scratch.save(texts.mapInArrow(_blocks(window, k), _BLOCKS), "blocks")
    found = scratch.save(
        blocks.groupBy("anchor")
        .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("block").alias("b0"), F.max("block").alias("b1"))
        .where("lo < hi")
        .select("anchor", (F.col("b0") != F.col("b1")).alias("varied")),
        "anchors",
    )
    near = scratch.save(blocks.join(found, "anchor"), "near")
    scratch.drop("blocks")
    copied = scratch.save(
        near.groupBy("anchor", "block").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor", "block", "lo"),
        "copied",
    )
    held = scratch.save(near.join(copied, ["anchor", "block"], "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("lo"), F.lit(False))).select("doc_id", "text_key", "loc", "anchor", "varied", "copy"), "held")
    scratch.drop("near")
    start, length = F.shiftright("loc", SHIFT), F.col("loc").bitwiseAND((1 << SHIFT) - 1)
    factors = held.where("copy").select("doc_id", "text_key", start.alias("start"), (start + length + window - 1).alias("stop"))
    asked = held.where("varied and not copy").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("loc", "anchor")).alias("asked"))
    wanted = texts.join(asked, ["doc_id", "text_key"]).select("doc_id", "text", "text_key", "asked")
    windows = scratch.save(wanted.mapInArrow(_windows(window), _WINDOWS), "windows")
    shared = scratch.save(windows.groupBy("anchor", "win").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor", "win", "lo"), "shared")
    edges = windows.join(shared, ["anchor", "win"]).where("doc_id > lo")
    edges = edges.select("doc_id", "text_key", "start", (F.col("start") + window).alias("stop"))
    return factors.unionByName(edges)


def _with_spans(docs: DataFrame, scratch: Scratch, window: int) -> DataFrame:
    """Documents with the list of their duplicate word ranges, null if none."""
    spans = duplicate_spans(docs, scratch, window)
    listed = scratch.save(spans.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "stop")).alias("_spans")), "spans")
    for name in ("anchors", "copied", "held", "windows", "shared"):
        scratch.drop(name)
    listed = listed.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "_spans")
    same = (docs.doc_id == F.col("_id")) & (F.xxhash64(docs.text) == F.col("_key"))
    return docs.join(listed, same, "left").select(*[docs[c] for c in docs.columns], "_spans")


def _gone(n: int, spans) -> np.ndarray:
    """Which of a text's n words its ranges cover."""
    edge = np.zeros(n + 1, np.int64)
    for s in spans or ():
        edge[s["start"]] += 1
        edge[s["stop"]] -= 1
    return np.cumsum(edge[:n]) > 0


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, spans = batch.column(0), batch.column(1), batch.column(2)
        n_words, n_removed, kept = [], [], []
        for i in range(len(ids)):
            raw = (texts[i].as_py() or "").encode()
            words = raw.split()
            if spans[i].is_valid:
                gone = _gone(len(words), spans[i].as_py())
                held = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            else:
                held = words
            n_words.append(len(words))
            n_removed.append(len(words) - len(held))
            kept.append(hashlib.sha256(b" ".join(held)).hexdigest())
        yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, removed words and the hash of the kept words.

    A null or empty text has no words; rows that repeat a doc_id are judged text
    by text, and rows without a doc_id lose nothing.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = _with_spans(docs, Scratch(spark, "op9"), WINDOW_WORDS)
    return held.select("doc_id", "text", "_spans").mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0)
        out = []
        for i in range(len(texts)):
            text, spans = texts[i].as_py(), batch.column(1)[i].as_py()
            if text is None or not spans:
                out.append(text)
                continue
            data = np.frombuffer(text.encode(), np.uint8)
            starts, ends, _ = _text.split_words(data, np.array([0, len(data)]), _text.SPACE_WORDS)
            gone = _gone(len(starts), spans)
            # each removed word goes with the white space that follows it
            to = np.append(starts[1:], len(data))
            edge = np.zeros(len(data) + 1, np.int64)
            np.add.at(edge, starts[gone], 1)
            np.add.at(edge, to[gone], -1)
            keep = np.cumsum(edge[:-1]) == 0
            out.append(data[keep].tobytes().decode())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *batch.columns[2:]], ["text", *batch.schema.names[2:]])


def remove_duplicates(spark: SparkSession, docs: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """``docs`` with every duplicate word range cut out of ``text``.

    A word goes if a window of ``window`` words that covers it also starts in a
    document with a smaller doc_id.  Null and empty texts, and rows without a
    doc_id, stay as they are; documents that lose all their words stay with an
    empty text.  Rows that repeat a doc_id are judged text by text, and none is a
    smaller document of the other.  Other columns, whatever their names, pass
    through.
    """
    names = docs.columns
    docs, old = shielded(docs, "_spans", "_id", "_key")
    held = _with_spans(docs, Scratch(spark, "substring"), window)
    others = [c for c in docs.columns if c != "text"]
    fields = {f.name: f for f in docs.schema.fields}
    from pyspark.sql.types import StructType

    out = held.select("text", "_spans", *others).mapInArrow(_cut, StructType([fields["text"], *(fields[c] for c in others)]))
    return out.withColumnsRenamed(old).select(*names)
