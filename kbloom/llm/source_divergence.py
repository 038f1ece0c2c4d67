"""How far the sources of a language diverge in their words, with exact counts.

Terms are counted behind a count-min sketch.  Each task sketches the document
frequencies of its (language, term) pairs in ``DEPTH`` rows of ``WIDTH`` counters
that stop at the least frequency asked for; sketches are added up, and as neither
a shared counter nor an early stop makes a sum smaller than the least of truth
and limit, no term is underestimated.  The second scan counts only terms whose
every counter reached the limit, so what can't be kept is never shuffled; the
survivors are counted exactly, and those the sketch let through wrongly go then.

Sources are compared by sums over all kept terms of a language.  A pair of
sources has three kinds of terms: in neither, which all have the same value; in
one, whose values depend on the count alone, so a histogram of counts is joined
with the sources; in both, which a join of the sparse counts on the term brings.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbloom.llm import _text
from kbloom.llm._io import Scratch, Shared, table

#: A term is kept by a language that has it in so many documents.
LEAST_DOCS = 3
#: Terms reported for each source.
TOP_TERMS = 200
#: Rows and counters a row of the sketch: 12 MB in a worker, 1.5 MB as the broadcast set.
DEPTH, WIDTH = 3, 1 << 22
#: Counters in one row of a sketch table.
_SLICE = 1 << 16
#: Text that is counted at once; longer documents are cut between terms.
_PIECE = 2 << 20

#: Bytes of a term, lower-cased: a-z and all of U+0080 and up.
LETTERS = np.zeros(256, bool)
LETTERS[0x61:0x7B] = LETTERS[0x80:] = True

_COUNTS = "lang string, source string, term string, n long, docs long"


def _pieces(column: pa.Array):
    """(first row, rows, bytes, offsets, whether the row goes on) with at most ``_PIECE`` bytes."""
    for lo, hi, data, offsets in _text.chunks(column, _PIECE):
        if len(data) <= _PIECE:
            yield lo, hi - lo, data, offsets, False
            continue
        gaps = np.flatnonzero(~LETTERS[_text.LOWER[data]])
        at, more = 0, False
        while at < len(data):
            k = int(np.searchsorted(gaps, at + _PIECE))
            # behind the last gap within a piece; a term longer than that stays whole
            k -= k > 0 and gaps[k - 1] > at
            end = int(gaps[k]) + 1 if k < len(gaps) and at + _PIECE < len(data) else len(data)
            yield lo, 1, data[at:end], np.array([0, end - at]), more
            at, more = end, True


class Found:
    """The distinct terms of a piece, and how often each document has them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = _text.LOWER[data]
        starts, ends, first = _text.split_words(self.data, offsets, LETTERS)
        self.doc = self.code = self.n = np.zeros(0, np.int64)
        self.hash, self.starts, self.ends = np.zeros(0, np.uint64), starts, ends
        if len(starts) == 0:
            return
        h = _text.word_hashes(self.data, starts, ends)
        other = _text.range_hashes(self.data.astype(np.uint64) + np.uint64(1), _text.SECOND_BASE)(starts, ends)
        self.hash, at, code = np.unique(h, return_index=True, return_inverse=True)
        if (other != other[at][code]).any():  # two terms of one hash
            _, at, code = np.unique(np.stack([h, other], 1), axis=0, return_index=True, return_inverse=True)
            self.hash, code = h[at], code.ravel()
        self.starts, self.ends = starts[at], ends[at]
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        pairs, self.n = np.unique(doc * len(at) + code, return_counts=True)
        self.doc, self.code = np.divmod(pairs, len(at))

    def words(self, codes: np.ndarray) -> pa.Array:
        starts, each = self.starts[codes], self.ends[codes] - self.starts[codes]
        offsets = np.concatenate([[0], np.cumsum(each)])
        raw = self.data[np.repeat(starts - offsets[:-1], each) + np.arange(offsets[-1])]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(codes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.large_string()).cast(pa.string())


def _scan(batch: pa.RecordBatch):
    """(Found, hash of each of its pairs, first row, pairs of documents new to their term)."""
    names = batch.column(0).dictionary_encode()
    seeds = np.array([xxhash.xxh64_intdigest(x.as_py()) for x in names.dictionary], np.uint64)
    lang = np.asarray(names.indices)
    seen = np.zeros(0, np.uint64)
    for lo, n, data, offsets, more in _pieces(batch.column(2)):
        found = Found(data, offsets)
        # documents of one language and term share a hash
        keyed = _text.mix(found.hash[found.code] ^ seeds[lang[lo + found.doc]]) if len(found.doc) else np.zeros(0, np.uint64)
        if n > 1 or not more:
            seen = np.zeros(0, np.uint64)
        fresh = ~np.isin(keyed, seen) if len(seen) else np.ones(len(keyed), bool)
        if n == 1:
            seen = np.union1d(seen, keyed)
        yield found, keyed, lo, fresh


def _places(keyed: np.ndarray, row: int, width: int) -> np.ndarray:
    return (_text.mix(keyed + np.uint64((row + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) & np.uint64(width - 1)).astype(np.int64)


def _sketched(least: int, width: int):
    """One task's sketch as (slice, counters), at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((DEPTH, width), np.uint8)
        for batch in batches:
            for _, keyed, _, fresh in _scan(batch):
                each, n = np.unique(keyed[fresh], return_counts=True)
                for row in range(DEPTH):
                    place, back = np.unique(_places(each, row, width), return_inverse=True)
                    more = np.bincount(back, weights=n, minlength=len(place))
                    held[row, place] = np.minimum(held[row, place] + more, least).astype(np.uint8)
        slices = held.reshape(-1, min(_SLICE, width))
        used = np.flatnonzero(slices.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([zlib.compress(slices[k].tobytes(), 1) for k in used], pa.binary())], ["slice", "counters"])

    return run


def _added(least: int):
    """Adds up the rows of each slice, which come one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([zlib.compress(np.packbits(held >= least).tobytes())], pa.binary())], ["slice", "full"])

        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                now = np.frombuffer(zlib.decompress(raw.as_py()), np.uint8)
                if k != at:
                    if at is not None:
                        yield row()
                    at, held = k, now
                else:
                    held = np.minimum(held + now, least)
        if at is not None:
            yield row()

    return run


def sketch(spark: SparkSession, docs: DataFrame, least: int = LEAST_DOCS, width: int = WIDTH) -> Shared:
    """The sketch's counters that reached ``least``, as a broadcast set of fixed size.

    ``docs(lang, source, text)`` has no nulls.  Sketches of tasks are added up in
    tasks, slice by slice; DEPTH * width bits reach the driver.
    """
    parts = docs.mapInArrow(_sketched(least, width), "slice long, counters binary")
    rows = parts.repartition("slice").sortWithinPartitions("slice").mapInArrow(_added(least), "slice long, full binary")
    each = min(_SLICE, width)
    bits = np.zeros(DEPTH * width // 8, np.uint8)
    for r in rows.toLocalIterator():
        bits[r.slice * each // 8 : (r.slice + 1) * each // 8] = np.frombuffer(zlib.decompress(r.full), np.uint8)
    return Shared(spark, (zlib.compress(bits.tobytes(), 1), width))


def _unpacked(value) -> np.ndarray:
    return np.frombuffer(zlib.decompress(value[0]), np.uint8).reshape(DEPTH, -1)


def _counted(full: Shared):
    """(lang, source, term, n, docs) of each piece, of terms that the sketch has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = full.once(_unpacked)
        width = bits.shape[1] * 8
        for batch in batches:
            groups: dict = {}
            own = np.array([groups.setdefault(x, len(groups)) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.int64)
            langs, sources = (pa.array([g[k] for g in groups], pa.string()) for k in (0, 1))
            for found, keyed, lo, fresh in _scan(batch):
                keep = np.ones(len(keyed), bool)
                for row in range(DEPTH):
                    at = _places(keyed, row, width)
                    keep &= (bits[row][at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
                if not keep.any():
                    continue
                pairs, back = np.unique(own[lo + found.doc[keep]] * len(found.hash) + found.code[keep], return_inverse=True)
                n = np.bincount(back, weights=found.n[keep], minlength=len(pairs)).astype(np.int64)
                docs = np.bincount(back, weights=fresh[keep], minlength=len(pairs)).astype(np.int64)
                group, code = np.divmod(pairs, len(found.hash))
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(group)), sources.take(pa.array(group)), found.words(code), pa.array(n), pa.array(docs)], ["lang", "source", "term", "n", "docs"])

    return run


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (total + terms)); 0 without a kept term."""
    scale, below = F.lit(1_000_000_000), total + terms
    whole = F.call_function("div", (count + 1) * scale, below)
    wide = F.call_function("div", (count + 1).cast("decimal(20,0)") * scale.cast("decimal(10,0)"), below.cast("decimal(20,0)"))
    return F.when(below == 0, F.lit(0)).when(count < 9_000_000_000, whole + 1).otherwise(wide + 1).cast("long")


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most 10^9 + 1, so it fits."""
    return F.call_function("div", (p - q) * (p - q), q)


def counts(spark: SparkSession, docs: DataFrame, scratch: Scratch, least: int = LEAST_DOCS, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Exact counts of kept terms by source, and the groups.

    (lang, source, term, n, total) with the language's total, and (lang, source,
    size, terms, lang_size) for every occurring source of a language.
    """
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    full = sketch(spark, docs, least, width)
    each = docs.mapInArrow(_counted(full), _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    each = scratch.save(each, "survivors")
    kept = each.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= least).drop("docs")
    kept = scratch.save(kept, "kept")
    held = scratch.save(each.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "total"), "held")
    scratch.drop("survivors")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_size"))
    sizes = held.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    every = docs.select("lang", "source").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows")).drop("rows")
    zero = F.lit(0).cast("long")
    groups = every.join(langs, "lang", "left").join(sizes, ["lang", "source"], "left").select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("size", "terms", "lang_size")])
    return held, scratch.save(groups, "groups")


def pairs(held: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """(lang, source, item, value): for each source every other one of its language."""
    none = F.lit(0).cast("long")
    named = groups.select("lang", "source", "size", "terms", share(none, F.col("size"), F.col("terms")).alias("none"))
    q = named.select("lang", F.col("source").alias("item"), F.col("size").alias("size_q"), F.col("none").alias("none_q"))
    both = named.join(q, "lang").where("source <> item")
    # terms in neither source, as if that were all
    base = both.select("lang", "source", "item", F.when(F.col("terms") > 0, gap(F.col("none"), F.col("none_q")) * F.col("terms")).otherwise(none).alias("value"))
    # terms in one source, by count
    hist = held.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("many"))
    at = hist.join(named, ["lang", "source"]).select("lang", "source", "many", F.col("none").alias("own_none"), share(F.col("n"), F.col("size"), F.col("terms")).alias("own"))
    at = scratch.save(at, "shares")
    other = named.select("lang", F.col("source").alias("other"), F.col("none").alias("other_none"))
    ones = at.join(other, "lang").where("source <> other")
    own, own_none, far = F.col("own"), F.col("own_none"), F.col("other_none")
    ones = ones.groupBy("lang", "source", "other").agg(F.sum(F.col("many") * (gap(own, far) - gap(own_none, far))).alias("as_p"), F.sum(F.col("many") * (gap(far, own) - gap(far, own_none))).alias("as_q"))
    ones = scratch.save(ones, "ones")
    left = ones.select("lang", "source", F.col("other").alias("item"), F.col("as_p").alias("value"))
    right = ones.select("lang", F.col("other").alias("source"), F.col("source").alias("item"), F.col("as_q").alias("value"))
    # terms in both: what their value differs from the sum of the above
    sparse = held.join(named, ["lang", "source"]).select("lang", "term", "source", F.col("none").alias("z"), share(F.col("n"), F.col("size"), F.col("terms")).alias("p"))
    sparse = scratch.save(sparse, "sparse")
    a, b = (sparse.select("lang", "term", F.col("source").alias(f"s_{x}"), F.col("z").alias(f"z_{x}"), F.col("p").alias(f"p_{x}")) for x in "ab")

    def rest(x: str, y: str) -> Column:
        p, z, q, w = F.col(f"p_{x}"), F.col(f"z_{x}"), F.col(f"p_{y}"), F.col(f"z_{y}")
        return F.sum(gap(p, q) - gap(p, w) - gap(z, q) + gap(z, w))

    shared = a.join(b, ["lang", "term"]).where("s_a < s_b").groupBy("lang", "s_a", "s_b").agg(rest("a", "b").alias("ab"), rest("b", "a").alias("ba"))
    shared = scratch.save(shared, "shared")
    ab = shared.select("lang", F.col("s_a").alias("source"), F.col("s_b").alias("item"), F.col("ab").alias("value"))
    ba = shared.select("lang", F.col("s_b").alias("source"), F.col("s_a").alias("item"), F.col("ba").alias("value"))
    rows = base.unionByName(left).unionByName(right).unionByName(ab).unionByName(ba)
    return rows.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def terms(held: DataFrame, groups: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, item, value, rank) of the terms a source uses more than its language."""
    p, q = share(F.col("n"), F.col("size"), F.col("terms")), share(F.col("total"), F.col("lang_size"), F.col("terms"))
    each = held.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    return _ranked(each.select("lang", "source", "item", gap(F.col("p"), F.col("q")).alias("value"))).where(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def audit(spark: SparkSession, docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS, width: int = WIDTH) -> DataFrame:
    """(lang, source, part, item, value, rank) of the divergences of ``docs``.

    Part ``pair``: every other source of the language; part ``term``: the
    leading ``top`` terms that the source uses more than its language.  Null
    text, lang and source count as empty; a group without terms has pairs and no
    terms; a language without kept terms has pairs of value 0.  Repeated rows
    are documents each.  Equal values rank by item.  An empty table has no rows.
    """
    scratch = Scratch(spark, "divergence")
    held, groups = counts(spark, docs, scratch, least, width)
    found = {"pair": _ranked(pairs(held, groups, scratch)), "term": terms(held, groups, top)}
    out = [rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, rows in found.items()]
    return out[0].unionByName(out[1])


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources and leading terms of all of ``documents``."""
    return audit(spark, table(spark, sf_dir, "documents").select("lang", "source", "text"))


_SHARE = "(1 + (1000000000 * ({0} + 1)::HUGEINT) // ({1} + v))"
_GAP = "(({0} - {1}) * ({0} - {1})) // {1}"

OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT k, lang, source, unnest(w) AS t FROM d),
kept AS (SELECT lang, t, count(*) AS total FROM o GROUP BY lang, t HAVING count(DISTINCT k) >= {LEAST_DOCS}),
l AS (SELECT g.lang, coalesce(v, 0) AS v, coalesce(nl, 0) AS nl FROM (SELECT DISTINCT lang FROM d) g LEFT JOIN (SELECT lang, count(*) AS v, sum(total) AS nl FROM kept GROUP BY lang) USING (lang)),
c AS (SELECT lang, source, t, count(*) AS n FROM o SEMI JOIN kept USING (lang, t) GROUP BY lang, source, t),
g AS (SELECT lang, source, v, nl, coalesce(s, 0) AS s FROM (SELECT DISTINCT lang, source FROM d) JOIN l USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS s FROM c GROUP BY lang, source) USING (lang, source)),
p AS (SELECT g.lang, g.source, v, kept.t, coalesce(n, 0) AS n, {_SHARE.format('coalesce(n, 0)', 's')} AS p, {_SHARE.format('total', 'nl')} AS q FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = kept.t),
x AS (SELECT a.lang, a.source, b.source AS item, sum({_GAP.format('a.p', 'b.p')}) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
      UNION ALL SELECT lang, source, 'term', t, ({_GAP.format('p', 'q')})::BIGINT FROM p WHERE n > 0 AND p > q),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
SELECT * FROM k WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
