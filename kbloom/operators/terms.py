"""Terms of a site: frequencies, co-occurrence and themes."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbloom.functions import text as T
from kbloom.functions.dialect import half_up
from kbloom.sources.scratch import small_batches


#: Terms frequent enough for a theme, and not on nearly every page.
MAY_FOUND = "tf >= 4 and spread < 0.9"


def incidence(docs: DataFrame) -> DataFrame:
    """(site, doc, term, n, pos): how often a term is in each document.

    ``docs(site, doc, text)``; pos is the term's first place in the document.
    Texts are dealt out by site and document, so both groupings need no further
    shuffle and a task holds the documents of few sites.
    """
    placed = docs.select("site", "doc", "text").repartitionByRange("site", "doc")
    each = placed.select("site", "doc", F.posexplode(T.words(F.col("text"))).alias("pos", "word"))
    # a word is tested once for each document that has it
    words = each.groupBy("site", "doc", "word").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    return words.select("site", "doc", "n", "pos", T.term(F.col("word")).alias("term")).where("term is not null").groupBy("site", "doc", "term").agg(F.sum("n").alias("n"), F.min("pos").alias("pos"))


def statistics(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(site, term, tf, df, spread) over a site's documents."""
    size = docs.groupBy("site").agg(F.count(F.lit(1)).alias("docs"))
    each = found.groupBy("site", "term").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"), F.min(F.struct("doc", "pos")).alias("first"))
    return each.join(size, "site").withColumn("spread", F.col("df") / F.greatest(F.col("docs"), F.lit(1)))


def top_terms(docs: DataFrame, most: int = 15, least: int = 3) -> DataFrame:
    """The most frequent terms of each site of ``docs(site, text)``, alphabetical among equals."""
    words = docs.select("site", F.explode(T.words(F.col("text"))).alias("word")).groupBy("site", "word").agg(F.count(F.lit(1)).alias("n"))
    each = words.select("site", "n", T.term(F.col("word")).alias("term")).where("term is not null").groupBy("site", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("n"), "term"))).where(F.col("rank") <= most)


def candidates(stats: DataFrame) -> DataFrame:
    """Terms that may found a theme, in order of frequency and first place."""
    good = stats.where(MAY_FOUND)
    return good.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("tf"), "first")))


#: Terms of a strip, where a site's terms are known; strips of a site at most, and bytes of text that give one strip, where they aren't.
BLOCK, STRIPS, STRIP_BYTES = 1024, 4, 8 << 20
#: Postings that a task holds at once, and cells and pairs that it counts at once.
POSTINGS, CELLS = 1 << 21, 1 << 20
#: Rows of an Arrow batch.
ROWS = 1 << 15


def _posted(most: int):
    """(site, term, tf, df, docs) of rows (site, term, doc, n) in the order of documents.

    A partition's documents are numbered in their order, so a task that runs anew
    gives the same numbers; docs has two-byte words: two for the partition, one
    for the upper half of all numbers, how many follow less one, and their lower
    halves.  Documents without an id count, but have no number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, last = TaskContext.get().partitionId(), -1, None
        codes, held, open_chunk = {}, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            code, low, n, named = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(code[named], kind="stable")
            n_docs = np.bincount(code[named], minlength=len(codes))
            head, size = np.array([part & 0xFFFF, part >> 16, open_chunk, 0], "<u2"), np.where(n_docs > 0, n_docs + 4, 0)
            ends = np.concatenate([[0], np.cumsum(size)])
            words, some = np.empty(ends[-1], "<u2"), np.flatnonzero(n_docs)
            at_head = ends[some][:, None] + np.arange(4)
            words[at_head] = head
            words[at_head[:, 3]] = n_docs[some] - 1
            body = np.ones(len(words), bool)
            body[at_head] = False
            words[body] = low[named][order]
            docs = pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer((2 * ends).astype(np.int32).tobytes()), pa.py_buffer(words.tobytes())])
            site, term = zip(*codes, strict=True)
            tf, df = np.bincount(code, weights=n, minlength=len(codes)).astype(np.int64), np.bincount(code, minlength=len(codes))
            columns = [pa.array(site, pa.string()), pa.array(term, pa.string()), pa.array(tf), pa.array(df.astype(np.int64)), docs]
            codes.clear(), held.clear()
            whole = pa.RecordBatch.from_arrays(columns, ["site", "term", "tf", "df", "docs"])
            for row in range(0, whole.num_rows, ROWS):
                yield whole.slice(row, ROWS)

        for batch in batches:
            if not batch.num_rows:
                continue
            site, term, doc, n = batch.columns
            named = ~np.asarray(doc.is_null())
            ids = np.asarray(doc.dictionary_encode().indices.fill_null(-1))
            new = np.concatenate([[doc[0].as_py() != last], np.diff(ids) != 0]) & named
            number, last = at + np.cumsum(new), doc[-1].as_py()
            at = int(number[-1])
            # a pair of site and term is looked up once a batch
            sites, words = site.dictionary_encode(), term.dictionary_encode()
            each, back = np.unique(np.asarray(sites.indices).astype(np.int64) << 32 | np.asarray(words.indices), return_inverse=True)
            site, term = sites.dictionary.to_pylist(), words.dictionary.to_pylist()
            keys = [(site[x >> 32], term[x & 0xFFFFFFFF]) for x in each.tolist()]
            upper = np.maximum(number, 0) >> 16
            for chunk in range(int(upper[0]), int(upper[-1]) + 1):
                if held and (chunk != open_chunk or sum(len(x[0]) for x in held) >= most):
                    yield from flush()
                open_chunk, here = chunk, upper == chunk
                code = np.array([codes.setdefault(k, len(codes)) for k in keys] if here.all() else [codes.setdefault(keys[k], len(codes)) for k in back[here].tolist()], np.int64)
                held.append((code[back] if here.all() else code, (number[here] & 0xFFFF).astype("<u2"), np.asarray(n)[here], named[here]))
        if held:
            yield from flush()

    return run


def postings(found: DataFrame, most: int = POSTINGS) -> DataFrame:
    """(site, term, tf, df, posts): a term's documents by number, two bytes each.

    All rows of a document are in one partition of ``found(site, doc, term, n)``.
    Tasks gather the documents of a term before the shuffle, so a term is moved
    once for each partition of its site, and not for each of its documents.
    """
    placed = found.where("site is not null").select("site", "term", "doc", F.col("n").cast("long").alias("n")).sortWithinPartitions("doc")
    each = placed.mapInArrow(_posted(most), "site string, term string, tf long, df long, docs binary")
    return each.groupBy("site", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"), F.listagg("docs").alias("posts"))


class _Cell:
    """Terms of two strips of a site, or of one, and the pairs that they are in.

    Postings beyond a bound are in a file of the task's own that has no name.
    """

    def __init__(self, site: str, alone: bool, most: int):
        self.site, self.alone, self.most = site, alone, most
        self.names, self.rows, self.chunks = [], [], {}
        self.docs = [tempfile.SpooledTemporaryFile(4 * most) for _ in range(1 if alone else 2)]

    def add(self, side: np.ndarray, term: pa.Array, df: np.ndarray, posts: pa.BinaryArray) -> None:
        """Further terms, in their order."""
        bounds = np.frombuffer(posts.buffers()[1], np.int32)[posts.offset : posts.offset + len(posts) + 1]
        words = np.frombuffer(posts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].view("<u2") if bounds[-1] > bounds[0] else np.zeros(0, "<u2")
        at, ends = (bounds[:-1] - bounds[0]) // 2, (bounds[1:] - bounds[0]) // 2
        # the next part of every term at a time
        of, parts = np.flatnonzero(at < ends), []
        while len(of):
            parts.append((of, at[of]))
            at[of] += words[at[of] + 3].astype(np.int32) + 5
            of = of[at[of] < ends[of]]
        of, at = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(at)
        of, at = of[order], at[order].astype(np.int64)
        n = words[at + 3].astype(np.int64) + 1
        chunk = words[at].astype(np.int64) | words[at + 1].astype(np.int64) << 16 | words[at + 2].astype(np.int64) << 32
        each, back = np.unique(chunk, return_inverse=True)
        base = np.array([self.chunks.setdefault(c, len(self.chunks)) for c in each.tolist()], np.int64)
        if len(self.chunks) > 1 << 16:
            raise ValueError("texts of one site are in more than 65,536 parts")
        number = (np.repeat(base[back] << 16, n) + words[np.repeat(at + 4 - (np.cumsum(n) - n), n) + np.arange(n.sum())]).astype(np.uint32)
        size = np.bincount(of, weights=n, minlength=len(side)).astype(np.int64)
        of = np.repeat(side, size)
        for k, file in enumerate(self.docs):
            file.write(number[of == k].tobytes())
        self.names.append(term)
        self.rows.append((side, df, size))

    def _strips(self, ends: np.ndarray) -> list[tuple[int, int]]:
        """Runs of terms with a bounded number of postings, or of one term."""
        out, lo = [], 0
        while lo < len(ends) - 1:
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + self.most, "right")) - 1)
            out.append((lo, hi))
            lo = hi
        return out

    def _read(self, k: int, lo: int, hi: int) -> np.ndarray:
        self.docs[k].seek(4 * int(lo))
        return np.frombuffer(self.docs[k].read(4 * int(hi - lo)), np.uint32)

    def pairs(self) -> Iterator[pa.RecordBatch]:
        names = pa.chunked_array(self.names, pa.string()).combine_chunks()
        names = names if isinstance(names, pa.Array) else names.chunk(0)
        side, df, size = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        ranks = [np.flatnonzero(side == k) for k in range(len(self.docs))]
        ends = [np.concatenate([[0], np.cumsum(size[x])]) for x in ranks]
        p, q = 0, len(self.docs) - 1
        site = pa.repeat(pa.scalar(self.site, pa.string()), ROWS)
        for q0, q1 in self._strips(ends[q]):
            docs = self._read(q, ends[q][q0], ends[q][q1])
            order = np.argsort(docs, kind="stable")
            # terms of one document after the other, each document's in their order
            terms = np.repeat(np.arange(q1 - q0), np.diff(ends[q][q0 : q1 + 1]))[order]
            docs = docs[order]
            first = np.flatnonzero(np.concatenate([np.ones(min(1, len(docs)), bool), docs[1:] != docs[:-1]]))
            stop, docs = np.append(first[1:], len(docs)), docs[first]
            if not len(docs):
                continue
            for p0, p1 in self._strips(ends[p]):
                if self.alone and p0 > q0:
                    break
                mine = self._read(p, ends[p][p0], ends[p][p1])
                at = np.minimum(np.searchsorted(docs, mine), len(docs) - 1)
                lo, hi = first[at], np.where(docs[at] == mine, stop[at], first[at])
                if self.alone and p0 == q0:
                    # only the terms that follow in the document
                    lo = np.empty(len(order), np.int64)
                    lo[order] = np.arange(1, len(order) + 1)
                for x, y, both in _counts(ends[p][p0 : p1 + 1] - ends[p][p0], lo, hi, terms, q1 - q0):
                    x, y = ranks[p][p0 + x], ranks[q][q0 + y]
                    overlap = np.floor(both / np.minimum(df[x], df[y]) * 1e6 + 0.5) / 1e6
                    a, b = np.minimum(x, y), np.maximum(x, y)
                    for k in range(0, len(a), ROWS):
                        n = slice(k, k + ROWS)
                        yield pa.RecordBatch.from_arrays([site[: len(a[n])], names.take(pa.array(a[n])), names.take(pa.array(b[n])), pa.array(both[n]), pa.array(overlap[n])], ["site", "a", "b", "both", "overlap"])
        for file in self.docs:
            file.close()


def _counts(ends: np.ndarray, lo: np.ndarray, hi: np.ndarray, terms: np.ndarray, width: int):
    """(row, term, number) of the terms[lo:hi] of each row's postings, a bounded number of rows at a time."""
    sums = np.concatenate([[0], np.cumsum(hi - lo)])
    at_row, row, last = sums[ends], 0, len(ends) - 1
    while row < last:
        to = max(row + 1, min(row + CELLS // width, int(np.searchsorted(at_row, at_row[row] + CELLS, "right")) - 1))
        e, end, table = int(ends[row]), int(ends[to]), None
        while e < end:
            f = min(end, max(e + 1, int(np.searchsorted(sums, sums[e] + CELLS, "right")) - 1))
            n = hi[e:f] - lo[e:f]
            if sums[f] > sums[e]:
                cell = terms[np.repeat(lo[e:f] - (sums[e:f] - sums[e]), n) + np.arange(sums[f] - sums[e])]
                if to > row + 1:
                    cell = cell + np.repeat((np.searchsorted(ends, np.arange(e, f), "right") - 1 - row) * width, n)
                more = np.bincount(cell, minlength=(to - row) * width)
                table = more if table is None else table + more
            e = f
        if table is not None:
            x, y = np.nonzero(table.reshape(to - row, width))
            yield row + x, y, table[x * width + y]
        row = to


def _paired(most: int):
    """(site, a, b, both, overlap) of sorted rows (site, p, q, side, term, df, posts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cell = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            site, p, q, side, term, df, posts = batch.columns
            p, q, side, df = (np.asarray(x).astype(np.int64) for x in (p, q, side, df))
            names = site.dictionary_encode()
            new = (np.diff(np.asarray(names.indices)) != 0) | (np.diff(p) != 0) | (np.diff(q) != 0)
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                now = (site[lo].as_py(), int(p[lo]), int(q[lo]))
                if now != key:
                    if cell:
                        yield from cell.pairs()
                    key, cell = now, _Cell(now[0], now[1] == now[2], most)
                cell.add(side[lo:hi], term.slice(lo, hi - lo), df[lo:hi], posts.slice(lo, hi - lo))
        if cell:
            yield from cell.pairs()

    return run


def _pairs(posted: DataFrame, most: int) -> DataFrame:
    """Pairs of the terms of (site, term, df, posts, strips), each in the cell of its terms' strips."""
    strip = F.pmod(F.xxhash64("term"), F.col("strips")).cast("int")
    spread = posted.withColumn("c", strip).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)))
    rows = spread.select("site", F.least("c", "o").alias("p"), F.greatest("c", "o").alias("q"), (F.col("c") > F.col("o")).cast("int").alias("side"), "term", "df", "posts")
    # so many partitions whatever their bytes: few bytes give many pairs
    parts = 8 * posted.sparkSession.sparkContext.defaultParallelism
    rows = rows.repartition(parts, "site", "p", "q").sortWithinPartitions("site", "p", "q", "term")
    return small_batches(rows).mapInArrow(_paired(most), "site string, a string, b string, both long, overlap double")


def theme_pairs(found: DataFrame, docs: DataFrame, most: int = POSTINGS) -> DataFrame:
    """(site, a, b, both, overlap) for all pairs of terms that may found a theme.

    A site's terms are dealt out to ``STRIPS`` strips at most and a term's
    documents are sent to each pair of strips that it belongs to, so what is
    shuffled stays in proportion to the texts while the pairs grow as a square;
    no pair is shuffled.  ``found`` is what ``incidence`` gives for ``docs``.
    """
    size = docs.groupBy("site").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))
    each = postings(found).join(size, "site").withColumn("spread", F.col("df") / F.greatest(F.col("docs"), F.lit(1)))
    strips = F.least(F.lit(STRIPS), F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("bytes") / STRIP_BYTES)))).cast("int")
    return _pairs(each.where(MAY_FOUND).select("site", "term", "df", "posts", strips.alias("strips")), most)


def co_occurrence(found: DataFrame, terms: DataFrame, block: int = BLOCK, most: int = POSTINGS) -> DataFrame:
    """(site, a, b, both, overlap) for pairs of the given (site, term, df), in strips of about ``block`` terms."""
    held = found.where("doc is not null").select("site", "doc", "term", F.lit(1).alias("n")).repartition("site", "doc")
    strips = terms.groupBy("site").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("strips"))
    known = terms.select("site", "term", F.col("df").cast("long").alias("df")).join(strips, "site")
    return _pairs(postings(held, most).select("site", "term", "posts").join(known, ["site", "term"]), most)


def themes(found: DataFrame, ranked: DataFrame, cut, most: int = 8, related: int = 5) -> DataFrame:
    """Up to ``most`` themes of each site: a seed term and those that share its pages.

    One round finds every site's next seed, the best candidate not yet used, and
    the terms whose pages overlap the seed's by 0.6 of the smaller set.  Pages are
    one row each, in the order of sites; a round counts the terms of those that
    have their site's seed, and only the counts of each task are shuffled.
    ``cut(df, name)`` writes a table and reads it back.
    """
    pages = cut(found.where("doc is not null").groupBy("site", "doc").agg(F.collect_list("term").alias("terms")), "pages")
    left = cut(ranked.select("site", "term", "tf", "df", "rank"), "left-0")
    out = None
    for k in range(most):
        seed = cut(left.groupBy("site").agg(F.min_by(F.struct("term", "tf", "df"), "rank").alias("s")).select("site", F.col("s.term").alias("seed"), F.col("s.tf").alias("seed_tf"), F.col("s.df").alias("seed_df")), f"seed-{k}")
        mine = pages.join(seed.select("site", "seed"), "site").where(F.array_contains("terms", F.col("seed"))).select("site", F.explode("terms").alias("term"))
        counts = mine.groupBy("site", "term").agg(F.count(F.lit(1)).alias("both"))
        near = counts.join(left, ["site", "term"]).join(seed.select("site", "seed", "seed_df"), "site").where("term <> seed")
        near = near.where(F.col("both") / F.greatest(F.least("df", "seed_df"), F.lit(1)) >= 0.6)
        near = near.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy("rank"))).where(F.col("place") <= related)
        joined = near.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]).alias("related"))
        found_k = cut(seed.join(joined, "site", "left").select("site", F.lit(k + 1).alias("place"), "seed", "seed_tf", F.coalesce("related", F.array().cast("array<string>")).alias("related")), f"theme-{k}")
        out = found_k if out is None else out.unionByName(found_k)
        used = found_k.select("site", F.explode(F.concat(F.array("seed"), "related")).alias("term"))
        left = cut(left.join(used, ["site", "term"], "left_anti"), f"left-{k + 1}")
    total = F.sum("seed_tf").over(Window.partitionBy("site"))
    return out.select("site", "place", F.initcap("seed").alias("label"), half_up(F.col("seed_tf") / total, 2).alias("weight"), F.array_join(F.concat(F.array("seed"), "related"), "|").alias("terms"))
