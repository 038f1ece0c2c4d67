"""Divergence of sources against a plain count, and the sketch's bound."""

import re
from collections import Counter, defaultdict

import numpy as np

from kbloom.llm import source_divergence as sd

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows, least, top):
    docs = [(g or "", s or "", TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))) for g, s, t in rows]
    df, total, by, out = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), []
    for g, s, w in docs:
        df[g].update(set(w))
        total[g].update(w)
        by[g, s].update(w)
    for g, s in sorted(by):
        kept = [t for t in df[g] if df[g][t] >= least]

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = shares(by[g, s]), shares(total[g])
        pairs = []
        for h, o in sorted(by):
            if h == g and o != s:
                r = shares(by[h, o])
                pairs.append((o, sum((p[t] - r[t]) ** 2 // r[t] for t in kept)))
        terms = [(t, (p[t] - q[t]) ** 2 // q[t]) for t in kept if by[g, s][t] and p[t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(g, s, part, i, v, k + 1) for k, (i, v) in enumerate(ranked)]
    return sorted(out)


def corpus():
    rng = np.random.default_rng(4)
    words = [f"{a}{b}" for a in ("alpha", "Beta", "été", "ß", "naïve", "x") for b in "abcdefghij"] + ["日本", "don't", "A1B"]
    rows = [(str(rng.choice(["en", "de"])), str(rng.choice(["a", "b", "c", "d"], p=[0.6, 0.2, 0.1, 0.1])), " ".join(rng.choice(words, rng.integers(0, 40)))) for _ in range(120)]
    rows += [("en", "a", "Copy of one TEXT")] * 30
    rows += [(None, None, None), (None, "a", "only once"), ("fr", "a", ""), ("fr", "b", "1 2 3"), ("fr", None, None), ("en", "silent", "..."), ("de", "é", "Ünique"), ("xx", "a", "t t t"), ("xx", "a", "t"), ("xx", "z", "t u")]
    return rows


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, source string, text string, term string, n int").repartition(parts)


def test_audit_equals_a_plain_count(spark):
    rows = corpus()
    assert sorted(map(tuple, sd.audit(spark, frame(spark, rows)).collect())) == plain(rows, 3, 200)
    assert sorted(map(tuple, sd.audit(spark, frame(spark, rows), least=1, top=3).collect())) == plain(rows, 1, 3)


def test_long_texts_in_pieces(spark, monkeypatch):
    """A document is one document however often it is cut; a term longer than a piece stays whole."""
    rows = [("en", "a", "word other " * 900 + "é" * 3000 + " word"), ("en", "b", "word " + "é" * 3000), ("en", "a", "other é word"), ("en", "c", "word")]
    want = plain(rows, 2, 200)
    cut = []
    for size in (7, 100, 1 << 20):
        monkeypatch.setattr(sd, "_PIECE", size)
        batch = frame(spark, rows, 1).select("lang", "source", "text").toArrow().combine_chunks().to_batches()[0]
        total, fresh = Counter(), Counter()
        for found, _, _, new in sd._scan(batch):
            words = found.words(found.code).to_pylist()
            for w, n, f in zip(words, found.n.tolist(), new.tolist(), strict=True):
                total[w] += n
                fresh[w] += f
        cut.append((total, fresh))
    assert cut[0] == cut[1] == cut[2]
    assert cut[0][1]["word"] == 4 and cut[0][1]["é" * 3000] == 2
    monkeypatch.undo()
    assert sorted(map(tuple, sd.audit(spark, frame(spark, rows), least=2).collect())) == want


def test_a_crowded_sketch_never_underestimates(spark):
    """With a few counters all terms pass and the result is the same; with many, rare terms don't."""
    rows = corpus()
    want = plain(rows, 3, 200)
    for width in (8, 1 << 10):
        assert sorted(map(tuple, sd.audit(spark, frame(spark, rows), width=width).collect())) == want
    docs = spark.createDataFrame([("en", "a", f"often word{''.join(chr(97 + (k // 26**j) % 26) for j in range(3))}") for k in range(5000)], "lang string, source string, text string")
    full = sd.sketch(spark, docs)
    assert docs.mapInArrow(sd._counted(full), sd._COUNTS).select("term").distinct().count() < 10


def test_wide_counts_do_not_overflow(spark):
    from pyspark.sql import functions as F

    rows = [(0, 0, 5), (9 * 10**9, 10**13, 7), (10**13, 10**13, 1), (0, 0, 0), (3, 10, 5)]
    got = spark.createDataFrame(rows, "c long, n long, v long").select(sd.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (c + 1) // (n + v) if n + v else 0 for c, n, v in rows]


def test_empty_table(spark):
    assert sd.audit(spark, frame(spark, []).limit(0)).collect() == []
