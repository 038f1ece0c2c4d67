import random

from kbloom.llm import near_copies


def shingle_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1)))}


def brute(texts):
    """Smallest id of each class, by comparing all pairs."""
    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in range(len(texts))}


def corpus():
    draw = random.Random(5)
    line = "all rights are reserved by the owners of this page and their friends"
    texts = [None, "", "one two", "One  two", "one two three four five", "one two three four six"]
    for _ in range(60):
        base = [f"w{draw.randrange(4000)}" for _ in range(draw.randrange(20, 200))]
        texts.append(" ".join(base) + " " + line)
        for _ in range(draw.randrange(4)):
            near = list(base)
            for _ in range(draw.randrange(1, 7)):
                near[draw.randrange(len(near))] = f"x{draw.randrange(4000)}"
            texts.append(" ".join(near) + " " + line)
    chain = [f"c{k}" for k in range(100)]
    for k in range(0, 30, 5):
        texts.append(" ".join([f"d{i}" for i in range(k)] + chain[k:]))
    draw.shuffle(texts)
    return texts


def test_near_copies_are_found_as_by_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in near_copies.classes(spark, docs).collect()}
    assert got == brute(texts)


def test_common_shingles_change_no_result(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SAMPLE", 1)
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in near_copies.classes(spark, docs).collect()}
    assert got == brute(texts)


def test_pipeline_stage_removes_a_near_copy(spark):
    import corpus_pipeline

    words = [f"w{k}" for k in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:40], "other", *words[41:]])), (3, " ".join(words[::-1]))]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(x.doc_id for x in kept.collect()) == [1, 3]


def test_sketches_never_bound_too_low():
    import numpy as np

    draw = np.random.default_rng(3)
    for _ in range(300):
        n, m = draw.integers(1, 3000, 2)
        x = np.unique(draw.integers(0, 1 << 62, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: draw.integers(0, n + 1)], draw.integers(0, 1 << 62, m).astype(np.uint64)]))
        most = near_copies._most_common(near_copies._sketch(x), near_copies._sketch(y), min(len(x), len(y)))
        assert most >= len(np.intersect1d(x, y))
    # sets without a common member are told apart
    x, y = (np.unique(draw.integers(0, 1 << 62, 5000).astype(np.uint64)) for _ in "xy")
    assert not near_copies._enough(near_copies._most_common(near_copies._sketch(x), near_copies._sketch(y), 5000), 5000, 5000)
    full = np.arange(5000, dtype=np.uint64) * np.uint64(1 << 20)
    assert near_copies._most_common(near_copies._sketch(full), near_copies._sketch(full), 5000) == 5000


def unlike(draw, base, n):
    """Texts with two or three other words each: alike in large parts, few of them near-copies."""
    out = []
    for k in range(n):
        near = list(base)
        for j in draw.sample(range(len(near)), draw.randrange(2, 4)):
            near[j] = f"y{k}x{j}"
        out.append(" ".join(near))
    return out


def test_a_large_bucket_makes_no_row_for_a_pair(spark, monkeypatch):
    draw, made = random.Random(8), {}
    texts = unlike(draw, [f"b{k}" for k in range(120)], 300)
    texts += unlike(draw, [f"d{k}" for k in range(130)], 20)
    # some are near-copies of one member each
    texts += [f"{texts[k]} end{k}" for k in range(0, 300, 7)]
    save = near_copies.Scratch.save

    def counted(self, df, name):
        made[name] = (out := save(self, df, name)).count()
        return out

    monkeypatch.setattr(near_copies, "SAMPLE", 1)
    monkeypatch.setattr(near_copies, "BLOCK", 50, raising=False)
    monkeypatch.setattr(near_copies.Scratch, "save", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in near_copies.classes(spark, docs).collect()}
    assert got == brute(texts)
    assert max(made.values()) < 30 * len(texts), made
