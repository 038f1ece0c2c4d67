"""Benchmark decontamination by a broadcast hash set of word windows.

A benchmark item of ``WINDOW_WORDS`` words or more is its set of windows of so
many consecutive words; a shorter item is one window.  The hashes of all windows
are broadcast as a set of ``SET_BITS`` places, whose 32 MB are the same for a
benchmark of any size.  Executors scan every document's windows once with rolling
hashes; a window whose place is taken is a candidate.  Candidates are verified
word for word by a join with the table of benchmark windows, and the hits give
the word ranges and items of each document.

Only documents with a candidate are moved: at a thousand benchmark items some
hundredths of a percent of other windows are candidates, at a hundred million
windows a third, and the result is the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kbloom.llm import _text
from kbloom.llm._io import Scratch, Shared, shielded, table

WINDOW_WORDS = 10
#: Places of the broadcast set.
SET_BITS = 1 << 28

_SPANS = "array<struct<start: int, stop: int>>"
_FOUND = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("hash", pa.int64()), ("words", pa.string())]))
_FOUND_DDL = "array<struct<start: int, n: int, hash: bigint, words: string>>"


def _hashed(data: np.ndarray, offsets: np.ndarray):
    """Words of a chunk: lower-cased bytes, bounds, first word of each row, window hashes."""
    data = _text.LOWER[data]
    starts, ends, first = _text.split_words(data, offsets, _text.ALNUM_WORDS)
    return data, starts, ends, first, _text.range_hashes(_text.word_hashes(data, starts, ends), _text.FIRST_BASE) if len(starts) else None


def _windows(width: int):
    """Each item's windows: length, hash and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in _text.chunks(batch.column(1)):
                data, starts, ends, first, hashes = _hashed(data, offsets)
                raw, rows, lengths, held, words = data.tobytes(), [], [], [], []
                for r in range(len(first) - 1):
                    count = int(first[r + 1] - first[r])
                    n = min(count, width)
                    at = np.arange(first[r], first[r + 1] - n + 1) if count else np.zeros(0, np.int64)
                    rows += [lo + r] * len(at)
                    lengths += [n] * len(at)
                    held.append(hashes(at, at + n).view(np.int64) if count else at)
                    words += [b" ".join([raw[starts[w] : ends[w]] for w in range(i, i + n)]).decode() for i in at.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(lengths, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *held])), pa.array(words, pa.string())], ["item", "n", "hash", "words"])

    return run


class Places:
    """The broadcast set: taken places, and the window lengths that occur."""

    def __init__(self, held: tuple[list[int], bytes]):
        self.lengths, packed = held
        self.taken = np.frombuffer(zlib.decompress(packed), np.uint8)
        self.mask = np.uint64(8 * len(self.taken) - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        place = (hashes & self.mask).view(np.int64)
        return (self.taken[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


class Benchmark:
    """A benchmark's windows as a table and as the broadcast set of their hashes."""

    def __init__(self, spark: SparkSession, benchmark: DataFrame, width: int, scratch: Scratch):
        items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null")
        each = items.mapInArrow(_windows(width), "item string, n int, hash long, words string")
        # one row for each window, with the items that have it
        self.windows = scratch.save(each.groupBy("n", "hash", "words").agg(F.array_sort(F.collect_set("item")).alias("items")), "windows")
        lengths = sorted(r.n for r in self.windows.select("n").distinct().collect())
        low = F.col("hash").bitwiseAND(F.lit(SET_BITS - 1))
        parts = self.windows.groupBy(F.floor(low / 32768).alias("k")).agg(F.bitmap_construct_agg(F.pmod(low, F.lit(32768))).alias("bits"))
        taken = np.zeros(SET_BITS >> 3, np.uint8)
        for r in parts.toLocalIterator():
            taken[int(r.k) * 4096 : (int(r.k) + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
        self.places = Shared(spark, (lengths, zlib.compress(taken.tobytes(), 1)))


def _candidates(places: Shared):
    """Adds to each row (text first) its word count and its candidate windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Places = places.once(Places)
        for batch in batches:
            for lo, hi, data, offsets in _text.chunks(batch.column(0)):
                data, starts, ends, first, hashes = _hashed(data, offsets)
                found: dict[int, list] = {}
                if len(starts):
                    raw = data.tobytes()
                    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
                    for n in held.lengths:
                        at = np.arange(len(starts) - n + 1)
                        if len(at) == 0:
                            continue
                        own = hashes(at, at + n)
                        at = np.flatnonzero(held.has(own))
                        at = at[at + n <= first[1:][doc[at]]]
                        for i, h in zip(at.tolist(), own[at].view(np.int64).tolist(), strict=True):
                            words = b" ".join([raw[starts[w] : ends[w]] for w in range(i, i + n)]).decode()
                            found.setdefault(int(doc[i]), []).append({"start": i - int(first[doc[i]]), "n": n, "hash": h, "words": words})
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(first)), pa.array([found.get(i, []) for i in range(hi - lo)], _FOUND), *part.columns], ["_n", "_found", *part.schema.names])

    return run


def _scanned(docs: DataFrame, places: Shared) -> DataFrame:
    """``docs`` (text first) with _n, the words, and _found, the candidates."""
    schema = StructType([*StructType.fromDDL(f"_n long, _found {_FOUND_DDL}").fields, *docs.schema.fields])
    return docs.mapInArrow(_candidates(places), schema)


def _hits(found: DataFrame, benchmark: Benchmark) -> DataFrame:
    """(_id, _key, _spans, _items) of the texts with a verified window.

    ``found(_id, _key, _found)``.  Ranges and items of a text are gathered in one
    row: there are no more of them than its words and the benchmark's items.
    """
    each = found.where("size(_found) > 0").distinct().select("_id", "_key", F.explode("_found").alias("f")).select("_id", "_key", "f.*")
    true = each.join(benchmark.windows, ["n", "hash", "words"])
    span = F.struct("start", (F.col("start") + F.col("n")).alias("stop"))
    return true.groupBy("_id", "_key").agg(F.array_sort(F.collect_set(span)).alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("_items"))


def _key(text: str = "text"):
    """What tells texts of one doc_id apart."""
    return F.xxhash64(text)


def find_hits(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, width: int = WINDOW_WORDS) -> DataFrame:
    """``docs`` with _n (words), _spans (word ranges inside benchmark windows) and _items.

    Null and empty texts have no words and no hits.  An item without a word, or
    a null one, has no window; items with a null id cover words but are listed
    by no id.  Items that repeat an id count once.  Rows that repeat a doc_id are
    judged text by text.
    """
    docs, clean, joined, _ = _joined(spark, docs, benchmark, width)
    none = F.array().cast
    clean = clean.select("_n", none(_SPANS).alias("_spans"), none("array<string>").alias("_items"), *docs.columns)
    return clean.unionByName(joined)


def _joined(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, width: int):
    """Documents without a candidate as they are, those with one joined with their hits."""
    scratch = Scratch(spark, "decontaminate")
    held = Benchmark(spark, benchmark, width, scratch)
    docs = docs.select("text", *[c for c in docs.columns if c != "text"])
    scanned = _scanned(docs, held.places)
    suspects = scratch.save(scanned.where("size(_found) > 0").withColumns({"_id": F.col("doc_id"), "_key": _key()}), "suspects")
    hits = scratch.save(_hits(suspects.select("_id", "_key", "_found"), held), "hits")
    none = F.array().cast
    renamed = hits.select(F.col("_id").alias("_i"), F.col("_key").alias("_k"), "_spans", "_items")
    same = suspects["_id"].eqNullSafe(F.col("_i")) & (suspects["_key"] == F.col("_k"))
    joined = suspects.join(renamed, same, "left").select("_n", F.coalesce("_spans", none(_SPANS)).alias("_spans"), F.coalesce("_items", none("array<string>")).alias("_items"), *[suspects[c] for c in docs.columns])
    return docs, scanned.where("size(_found) = 0"), joined, scratch


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, hit words, items hit and the hash of their ids.

    A null or empty text has no words.  Rows that repeat a doc_id are judged text
    by text, those that repeat both alike.
    """
    docs, benchmark = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    return digest(spark, docs, benchmark)


def digest(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, width: int = WINDOW_WORDS) -> DataFrame:
    """The digest columns of ``docs(doc_id, text)``; no text is kept past the scan."""
    scratch = Scratch(spark, "op8")
    held = Benchmark(spark, benchmark, width, scratch)
    found = _scanned(docs.select("text", "doc_id"), held.places).select(F.col("doc_id").alias("_id"), _key().alias("_key"), "_n", "_found")
    found = scratch.save(found, "found")
    hits = scratch.save(_hits(found.select("_id", "_key", "_found"), held), "hits").withColumnsRenamed({"_id": "_i", "_key": "_k"})
    rows = found.join(hits, found["_id"].eqNullSafe(hits["_i"]) & (found["_key"] == hits["_k"]), "left")
    covered = F.array_distinct(F.flatten(F.transform("_spans", lambda s: F.sequence(s["start"], s["stop"] - 1))))
    items = F.coalesce("_items", F.array().cast("array<string>"))
    return rows.select(
        F.col("_id").alias("doc_id"),
        F.col("_n").alias("n_words"),
        F.coalesce(F.size(covered), F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        F.col("_spans").isNotNull().alias("contaminated"),
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rewrites text without the covered words."""
    for batch in batches:
        spans, texts, out = batch.column(0), batch.column(1), []
        for i in range(batch.num_rows):
            text, held = texts[i].as_py(), spans[i].as_py()
            if text is None or not held:
                out.append(text)
                continue
            raw = np.frombuffer(text.encode(), np.uint8)
            starts, ends, _ = _text.split_words(_text.LOWER[raw], np.array([0, len(raw)]), _text.ALNUM_WORDS)
            edge = np.zeros(len(raw) + 1, np.int64)
            for s in held:
                edge[starts[s["start"]]] += 1
                edge[ends[s["stop"] - 1]] -= 1
            out.append(raw[np.cumsum(edge[:-1]) == 0].tobytes().decode())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *batch.columns[2:]], ["text", *batch.schema.names[2:]])


def remove_benchmark(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, width: int = WINDOW_WORDS, drop_documents: bool = False) -> DataFrame:
    """``docs`` without benchmark passages: spans are cut, or documents go.

    With ``drop_documents`` every document with a hit is dropped; otherwise the
    hit words and what stands between them are cut from the text and the
    document stays, with an empty text if nothing is left.
    """
    names = docs.columns
    docs, old = shielded(docs, "_n", "_found", "_spans", "_items", "_id", "_key", "_i", "_k")
    docs, clean, joined, _ = _joined(spark, docs, benchmark, width)
    if drop_documents:
        return clean.select(*docs.columns).unionByName(joined.where("size(_spans) = 0").select(*docs.columns)).withColumnsRenamed(old).select(*names)
    cut = joined.select("_spans", *docs.columns).mapInArrow(_cut, docs.schema)
    return clean.select(*docs.columns).unionByName(cut).withColumnsRenamed(old).select(*names)
