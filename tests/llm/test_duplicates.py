"""Near-duplicate, substring and benchmark operators against brute force."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from kbloom.llm import decontaminate, simhash_dedup, substring_dedup
from kbloom.llm._graph import components
from kbloom.llm._io import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, text_hash string, a string, n int"


def rows(texts):
    return [(i, t, "en", "s", len(t or ""), "clash", "x", 1) for i, t in texts]


def corpus(seed=1, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 4)))
    shared = [" ".join(word() for _ in range(r.randint(8, 90))) for _ in range(6)]
    out = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(r.randint(0, 60))) for _ in range(3)]
        parts.insert(r.randint(0, 3), r.choice(shared))
        out.append((i, r.choice([" ", "\n", " \t "]).join(parts)))
    out += [(n, None), (n + 1, ""), (n + 2, "   \n"), (n + 3, out[0][1]), (n + 4, "tic toc " * 300), (n + 5, "toc tic " * 200), (n + 6, "  lone ")]
    return out


def spans_of(texts, window):
    seen, out = {}, {}
    for i, t in sorted(texts):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        own = [tuple(words[j : j + window]) for j in range(len(words) - window + 1)]
        for j, w in enumerate(own):
            if w in seen:
                gone[j : j + window] = [True] * window
        for w in own:
            seen.setdefault(w, i)
        out[i] = gone
    return out


@pytest.mark.parametrize("window,k", [(50, 12), (10, 3)])
def test_substring_spans_match_brute_force(spark, window, k):
    texts = corpus()
    docs = spark.createDataFrame(rows(texts), DOCS)
    found = substring_dedup.duplicate_spans(docs, Scratch(spark, "t"), window, k).collect()
    want = spans_of(texts, window)
    got = {i: [False] * len(g) for i, g in want.items()}
    for r in found:
        got[r.doc_id][r.start : r.stop] = [True] * (r.stop - r.start)
    assert got == want
    assert any(any(g) for g in want.values())


def test_substring_removal_keeps_other_columns_and_rows(spark):
    texts = corpus(2, 20)
    docs = spark.createDataFrame(rows(texts) + [(None, "no id", None, None, None, None, None, None)], DOCS)
    out = substring_dedup.remove_duplicates(spark, docs, 20)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    want = spans_of(texts, 20)
    for i, t in texts:
        words = (t or "").split()
        if t is None or not any(want[i]):
            assert got[i] == t
        else:
            assert got[i].split() == [w for w, g in zip(words, want[i], strict=True) if not g]
    assert got[None] == "no id"
    assert out.count() == len(texts) + 1


def test_substring_on_an_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert substring_dedup.remove_duplicates(spark, docs).collect() == []


LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text):
    words = (text or "").encode().translate(LOWER).split()
    shingles = [b" ".join(words[j : j + 3]) for j in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def linked(fps):
    """Smallest index reachable over links of two bits or fewer."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints_and_classes(spark):
    texts = corpus(3) + [(100 + i, f"Same words again and again number {i // 3}") for i in range(12)]
    got = {r.doc_id: r for r in simhash_dedup.classes(spark, spark.createDataFrame(rows(texts), DOCS)).collect()}
    fps = [fingerprint(t) for _, t in texts]
    root = linked(fps)
    for k, (i, _) in enumerate(texts):
        assert got[i].fp % (1 << 64) == fps[k]
        assert got[i].component_id == min(texts[j][0] for j in range(len(texts)) if root[j] == root[k])


@pytest.mark.parametrize("most", [0, 3, 32])
def test_links_of_dense_groups(spark, most):
    """Chains, balls and random fingerprints; buckets paired or spread by size."""
    r = random.Random(4)
    fps = set()
    for _ in range(12):
        x = r.getrandbits(64)
        fps.add(x)
        for _ in range(r.randint(0, 25)):
            for _ in range(r.randint(0, 3)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps |= {1 << k for k in range(20)} | {0, (1 << 64) - 1}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    scratch = Scratch(spark, "t")
    edges = simhash_dedup.links(nodes, scratch, most)
    for e in edges.collect():
        assert (e.a ^ e.b if e.a ^ e.b >= 0 else (e.a ^ e.b) + (1 << 64)).bit_count() <= 2
    got = {x.node: x.component for x in components(edges, scratch).collect()}
    place = {signed(f): i for i, f in enumerate(fps)}
    named = {}
    for f in fps:
        named.setdefault(got.get(signed(f), signed(f)), []).append(place[signed(f)])
    root = {i: min(v) for v in named.values() for i in v}
    assert [root[i] for i in range(len(fps))] == linked(fps)


def signed(f):
    return f - (1 << 64) if f >> 63 else f


def test_a_crowd_within_few_bits_is_refined_to_the_end(spark):
    """Thousands of fingerprints around one value: every level of the ring is crowded."""
    r = random.Random(6)
    base = r.getrandbits(64)
    fps = {base ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)} | {base ^ sum(1 << k for k in r.sample(range(64), 6)) for _ in range(50)}
    nodes = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    scratch = Scratch(spark, "t")
    edges = simhash_dedup.links(nodes, scratch, 4).collect()
    assert len(edges) < 300 * len(fps)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    ball = [f for f in fps if (f ^ base).bit_count() == 2]
    assert len({got[signed(f)] for f in ball}) == 1
    assert all(signed(f) not in got or any((f ^ g).bit_count() <= 2 for g in fps if g != f) for f in fps)


def test_repeated_ids_with_other_texts(spark):
    a, b, c = "one two three four five", "six seven eight nine ten", "other words stand here now"
    texts = [(5, a), (9, a), (5, b), (8, b), (3, c), (3, b + " more")]
    got = {(r.doc_id, r.fp): r.component_id for r in simhash_dedup.classes(spark, spark.createDataFrame(rows(texts), DOCS)).collect()}
    fp = {t: signed(fingerprint(t)) for _, t in texts}
    assert got == {(5, fp[a]): 5, (9, fp[a]): 5, (5, fp[b]): 5, (8, fp[b]): 5, (3, fp[c]): 3, (3, fp[b + " more"]): 3}
    more = {(r.doc_id, r.fp): r.component_id for r in simhash_dedup.classes(spark, spark.createDataFrame(rows([*texts, (4, b)]), DOCS)).collect()}
    assert more[9, fp[a]] == 5 and more[8, fp[b]] == more[5, fp[b]] == 4
    kept = simhash_dedup.keep_first(spark, spark.createDataFrame(rows([*texts, (4, b)]), DOCS))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(5, a), (4, b), (3, c), (3, b + " more")])


def test_keep_first_leaves_one_of_each_class(spark):
    texts = [(5, "a b c d e"), (3, "a b c d e"), (4, "other words are in here"), (9, None), (8, "")]
    kept = simhash_dedup.keep_first(spark, spark.createDataFrame(rows(texts), DOCS))
    assert kept.columns == DOCS.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 8]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, k) for k in range(1001, 1100)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert all(got[i] == 0 for i in range(201))
    assert all(got[k] == 1000 for k in range(1000, 1100))


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").encode().translate(LOWER))


def contaminated(docs, items):
    grams = {}
    for i, t in items:
        w = words_of(t)
        for j in range(max(1, len(w) - 9) if w else 0):
            grams.setdefault(tuple(w[j : j + 10]), set()).add(str(i))
    out = {}
    for i, t in docs:
        w = words_of(t)
        hit, found = [False] * len(w), set()
        for n in {len(g) for g in grams}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in grams:
                    found |= grams[tuple(w[j : j + n])]
                    hit[j : j + n] = [True] * n
        out[i] = (len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit))
    return out


ITEMS = [
    (1, "One two three four five six seven eight nine ten eleven twelve"),
    (12, "Été à la mer"),
    (2, "short-item!"),
    (3, ""),
    (4, None),
    (5, "one two three four five six seven eight nine ten, and then more words follow here"),
    (2, "short item"),
]
TEXTS = [
    (0, "zero ONE two, three four-five six seven eight nine ten eleven twelve thirteen"),
    (1, "one two three four five six seven eight nine"),
    (2, "un été À la mer; Short\nITEM short item"),
    (3, None),
    (4, ""),
    (5, "… !!"),
    (6, "nothing of interest " * 50 + "one two three four five six seven eight nine ten and then more words follow here"),
]


@pytest.mark.parametrize("bits", [1 << 28, 1 << 15])
def test_contamination_matches_brute_force(spark, monkeypatch, bits):
    """Also with a set so small that many windows are candidates."""
    monkeypatch.setattr(decontaminate, "SET_BITS", bits)
    r = random.Random(12)
    filler = [" ".join(r.choice("abcdefgh") + r.choice("aeiou") for _ in range(400)) for _ in range(30)]
    texts = TEXTS + [(10 + k, t) for k, t in enumerate(filler)] + [(7, TEXTS[0][1]), (7, "another text of that id")]
    items = ITEMS + [(100 + k, t[:200]) for k, t in enumerate(filler[:5])] + [(200, filler[0][50:150])]
    docs = spark.createDataFrame(rows(texts), DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = contaminated(texts[:-2], items)
    got = [tuple(x) for x in decontaminate.digest(spark, docs.select("doc_id", "text"), bench).collect()]
    assert {x[0]: x[1:] for x in got if x[0] != 7} == want
    assert sorted(x[1:] for x in got if x[0] == 7) == sorted(contaminated([(k, t) for k, (_, t) in enumerate(texts[-2:])], items).values())
    hits = decontaminate.find_hits(spark, docs, bench)
    assert {(x.doc_id, len({i for s in x._spans for i in range(s.start, s.stop)}), len(x._items)) for x in hits.collect() if x.doc_id != 7} == {(k, v[1], v[2]) for k, v in want.items()}


def test_benchmark_removal(spark):
    docs = spark.createDataFrame(rows(TEXTS), DOCS)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontaminate.remove_benchmark(spark, docs, items)
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[0] == "zero  thirteen"
    assert texts[1] == TEXTS[1][1] and texts[3] is None and texts[5] == "… !!"
    kept = decontaminate.remove_benchmark(spark, docs, items, drop_documents=True)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5]
    none = decontaminate.remove_benchmark(spark, docs, items.limit(0))
    assert none.select(F.sum(F.length("text"))).first() == docs.select(F.sum(F.length("text"))).first()
