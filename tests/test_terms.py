"""Pairs of terms over blocks, and plans that shuffle no pairs."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kbloom.operators import terms
from kbloom.plans.catalogue import QUERIES


def test_blocks_count_what_plain_pairs_count(spark):
    r = random.Random(3)
    names = [f"w{chr(0x3B1 + k % 24)}{k}" for k in range(70)]
    rows = [(site, doc, t) for site in ("a", "b", "é") for doc in range(40) for t in r.sample(names[: 70 if site != "b" else 9], r.randint(1, 9))]
    # a document without an id meets no other, and names of documents may be strings
    held = spark.createDataFrame([*rows, ("a", None, names[0]), ("a", None, names[1])], "site string, doc long, term string")
    df = Counter((s, t) for s, _, t in rows)
    known = spark.createDataFrame([(s, t, n) for (s, t), n in df.items()], "site string, term string, df long")
    docs = {}
    for s, d, t in rows:
        docs.setdefault((s, d), set()).add(t)
    want = Counter((s, *p) for (s, _), ts in docs.items() for p in combinations(sorted(ts, key=lambda x: x.encode()), 2))
    want = {k: (n, int(n / min(df[k[0], k[1]], df[k[0], k[2]]) * 1e6 + 0.5) / 1e6) for k, n in want.items()}
    for found in (held, held.withColumn("doc", F.concat(F.lit("d"), F.col("doc").cast("string")))):
        for block in (8, 64, 1024):
            assert {(x.site, x.a, x.b): (x.both, x.overlap) for x in terms.co_occurrence(found, known, block).collect()} == want, block


def test_pairs_are_not_shuffled(spark):
    found = spark.createDataFrame([("a", 1, "x")], "site string, doc long, term string")
    plan = terms.co_occurrence(found, found.select("site", "term", F.lit(1).alias("df")))._jdf.queryExecution().executedPlan().toString()
    # the tree's root is first: no exchange follows the counting
    assert "Exchange" in plan and "Exchange" not in plan[: plan.index("MapInArrow")].split("Final Plan")[0]


def test_incidence_deals_texts_out_once(spark):
    docs = spark.createDataFrame([("a", 1, "Wells wells pumps"), ("a", 1, "pumps deep"), ("b", 2, None)], "site string, doc long, text string")
    found = terms.incidence(docs)
    shown = found._jdf.queryExecution().executedPlan().toString()
    assert {(x.doc, x.term, x.n) for x in found.collect()} == {(1, "wells", 2), (1, "pumps", 2), (1, "deep", 1)}
    assert shown.count("Exchange") == 1 and "rangepartitioning" in shown


def moved(plan) -> int:
    """Rows that the exchanges of a finished plan have written."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return moved(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return moved(plan.plan())
    own = plan.metrics().get("shuffleRecordsWritten")
    below = plan.children()
    return (own.get().value() if own.isDefined() else 0) + sum(moved(below.apply(k)) for k in range(below.size()))


def plain(rows, df):
    """Pairs of (site, doc, term) counted one by one."""
    held = {}
    for s, d, t in rows:
        if d is not None and (s, t) in df:
            held.setdefault((s, d), set()).add(t)
    both = Counter((s, *p) for (s, _), ts in held.items() for p in combinations(sorted(ts), 2))
    return {k: (n, int(n / min(df[k[0], k[1]], df[k[0], k[2]]) * 1e6 + 0.5) / 1e6) for k, n in both.items()}


def test_rows_moved_do_not_grow_with_the_terms_of_a_site(spark, tmp_path):
    """Terms of documents were moved once for each block of 1,024 terms of their site."""
    names = [f"{a}{b}{c}word" for a in "bcdfghklmnprst" for b in "aeiouy" for c in "bcdfghklmnprstvwxz"]
    docs = spark.createDataFrame([("a", d, " ".join(names[(d * 97 + k) % len(names)] for k in range(300) for _ in "12")) for d in range(60)], "source string, doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    pairs = QUERIES["term_cooccurrence"](spark, str(tmp_path))
    assert sum(x.both for x in pairs.collect()) == 60 * 300 * 299 // 2
    # 18,000 terms of documents; a term is moved once by a task that reads it and once for a strip
    assert 60 < moved(pairs._jdf.queryExecution().executedPlan()) < 18_000


def test_strips_and_parts_give_the_same_pairs(spark, monkeypatch):
    r = random.Random(5)
    vowels = [f"{a}{b}{c}{d}" for a in "bdk" for b in "aei" for c in "lmn" for d in ("ona", "'s")]
    rows = [("a", d, t) for d in [None, *range(30)] for t in r.sample(vowels, 9)] + [("b", d, t) for d in range(30) for t in r.sample(vowels[:12], 5)]
    texts = {}
    for s, d, t in rows:
        texts.setdefault((s, d), []).append(t)
    # a document in two rows is one; both rows count as documents
    split = [(s, d, " ".join(x)) for (s, d), ts in texts.items() for x in ((ts, ts[:2]) if d == 3 else (ts,))]
    # texts of no site give no pairs
    split += [(None, d, " ".join(vowels)) for d in range(6)]
    docs = spark.createDataFrame(split, "site string, doc long, text string").repartition(5)
    found = terms.incidence(docs)
    good = terms.statistics(found, docs).where(terms.MAY_FOUND)
    df = {(x.site, x.term): x.df for x in good.collect()}
    want = plain([(x.site, x.doc, x.term) for x in found.collect()], df)
    assert len(want) > 100 and {x[0] for x in want} == {"a", "b"}
    for size, most in ((8 << 20, 1 << 22), (1, 1 << 22), (1, 7), (8 << 20, 7)):
        monkeypatch.setattr(terms, "STRIP_BYTES", size)
        assert {(x.site, x.a, x.b): (x.both, x.overlap) for x in terms.theme_pairs(found, docs, most).collect()} == want, (size, most)


@pytest.mark.parametrize("cells", [1, 7, 40, 1 << 20])
def test_counts_are_the_same_for_any_bound(monkeypatch, cells):
    monkeypatch.setattr(terms, "CELLS", cells)
    r = random.Random(cells)
    of = np.array([r.randrange(9) for _ in range(60)])
    lo = np.array([r.randrange(50) for _ in range(40)])
    hi = np.array([min(60, x + r.choice((0, 0, 1, 3, 9))) for x in lo])
    ends = np.array([0, 0, 1, 12, 12, 30, 40])
    want = Counter((row, int(of[k])) for row in range(6) for e in range(ends[row], ends[row + 1]) for k in range(lo[e], hi[e]))
    got = [(int(x), int(y), int(n)) for part in terms._counts(ends, lo, hi, of, 9) for x, y, n in zip(*part, strict=True)]
    assert {(x, y): n for x, y, n in got} == want and len(got) == len(want)


def test_parts_of_a_partition_number_documents_on(monkeypatch):
    """Numbers beyond 65,536 go to a further chunk, and batches cut a document anywhere."""
    class Task:
        def partitionId(self):
            return 3

    monkeypatch.setattr(terms.TaskContext, "get", staticmethod(Task))
    each = [("a", t, d, 1) for d in range(70_000) for t in (("x", "y") if d % 2 else ("x",))]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*each[k : k + 9_999], strict=True)], ["site", "term", "doc", "n"]) for k in range(0, len(each), 9_999)]
    for most in (1 << 22, 20_000):
        got = {}
        for batch in terms._posted(most)(iter(batches)):
            for x in batch.to_pylist():
                part, zero, upper, n, *low = memoryview(x["docs"]).cast("H")
                assert (part, zero, n + 1, x["df"]) == (3, 0, len(low), len(low))
                got.setdefault(x["term"], []).extend(upper << 16 | k for k in low)
        assert got == {"x": list(range(70_000)), "y": list(range(1, 70_000, 2))}
