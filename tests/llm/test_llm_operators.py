"""The other operators of the subpackage, on small tables."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kbloom.llm import bpe, html_extract, language_id, licenses, quality_rules, sharding, url_filters
from kbloom.llm._io import Scratch

# --- language ---

EN = "the house and the garden were quiet in the evening while they talked about old friends and the weather".split()
FR = "la maison et le jardin étaient calmes dans la soirée pendant que nous parlions des vieux amis et du temps".split()
RU = "дом и сад были тихими вечером пока они говорили о старых друзьях и погоде".split()


def speech(words, seed, n=40):
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    held = [(speech(w, 10 * k + i), lang) for k, (lang, w) in enumerate([("en", EN), ("fr", FR), ("ru", RU)]) for i in range(10)]
    return language_id.train(spark.createDataFrame([*held, (None, "en"), ("text", None)], "text string, lang string"))


def test_spans_of_mixed_text(spark, model):
    mixed = speech(EN, 99, 30) + ". " + speech(FR, 98, 30) + " 12! " + speech(RU, 97, 20)
    texts = [(1, mixed), (2, None), (3, "  123 !? "), (4, speech(FR, 5)), (5, ""), (6, speech(RU, 6) * 2000)]
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t in texts], "doc_id long, text string, lang_pred string, score double")
    got = {r.doc_id: r for r in language_id.predict(spark, docs.drop("lang_pred", "score"), model, ["doc_id"]).collect()}
    assert [s.lang for s in got[1].lang_spans] == ["en", "fr", "ru"]
    first = got[1].lang_spans[0]
    assert mixed[first.start : first.stop] == speech(EN, 99, 30)
    assert (got[2].lang_pred, got[3].lang_pred, got[5].lang_pred) == ("und", "und", "und")
    assert got[2].score == 0 and got[2].lang_spans == []
    assert got[4].lang_pred == "fr" and got[4].score == 1.0
    assert got[6].lang_pred == "ru" and len(got[6].lang_spans) == 1


def test_viterbi_matches_a_plain_one():
    import numpy as np

    r = np.random.default_rng(1)
    sizes = [0, 1, 7, 30, 3, 0, 12]
    first = np.concatenate([[0], np.cumsum(sizes)])
    scores = r.normal(size=(first[-1], 3)).astype(np.float32) * 3
    path = language_id.viterbi(scores, first, 2.0)
    for d, n in enumerate(sizes):
        own = scores[first[d] : first[d + 1]]

        def value(p, own=own):
            return sum(own[t, s] for t, s in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))

        best = [(0.0, ())]
        if n:
            states = {s: (own[0, s], (s,)) for s in range(3)}
            for t in range(1, n):
                states = {s: max((v - 2.0 * (p[-1] != s) + own[t, s], (*p, s)) for v, p in states.values()) for s in range(3)}
            best = [max(states.values())]
        assert value(path[first[d] : first[d + 1]].tolist()) == pytest.approx(best[0][0], abs=1e-3)


def test_viterbi_with_many_languages():
    import numpy as np

    scores = np.full((4, 300), -50, np.float32)
    scores[:2, 299] = scores[2:, 130] = 0
    assert language_id.viterbi(scores, np.array([0, 4]), 2.0).tolist() == [299, 299, 130, 130]


def test_no_training_rows(spark):
    empty = language_id.train(spark.createDataFrame([], "text string, lang string"))
    docs = spark.createDataFrame([(1, "word")], "doc_id long, text string")
    assert tuple(language_id.predict(spark, docs, empty, ["doc_id"]).first()) == ("und", 0.0, [], 1)


# --- quality ---


def plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[j : j + 8]) for j in range(len(words) - 7)]
    times, hit = Counter(windows), [0] * len(words)
    for j, w in enumerate(windows):
        if times[w] > 1:
            hit[j : j + 8] = [1] * 8
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(hit), len(words) < 20 or 100 * sum(hit) > 30 * len(words))


def test_statistics_match_plain_ones(spark):
    r = random.Random(2)
    texts = ["", None, " \n\t", "one", "a b c d e f g h", "a b c d e f g h " * 3, "x\nx\n \nx y\nx y\n", "é # * $ % & | < > é", "tic " * 500]
    texts += [" ".join(r.choice("abc") for _ in range(r.randint(0, 60))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = quality_rules.statistics(docs, ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == {i: plain_statistics(t) for i, t in enumerate(texts)}


def test_learned_rules_separate_junk(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    good = [" ".join(word() for _ in range(r.randint(25, 80))) for _ in range(200)]
    bad = [" ".join(word() + "###" for _ in range(r.randint(25, 80))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(good + bad + [None])], "doc_id long, text string, n_words string, bad string")
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i in range(0, 240, 2)] + [(None, 0, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    kept = quality_rules.keep_good(spark, docs, labels)
    assert kept.columns == docs.columns
    held = {x.doc_id for x in kept.collect()}
    assert held >= set(range(200)) and len(held) <= 205 and 240 not in held
    scratch = Scratch(spark, "t")
    stats = quality_rules.statistics(docs.select("doc_id", "text"), ["doc_id"])
    assert len(quality_rules.learn(stats, labels, scratch)) == 1
    assert quality_rules.learn(stats, labels.limit(0), Scratch(spark, "t")) == []
    assert quality_rules.keep_good(spark, docs.limit(0), labels).count() == 0


# --- tokens ---


def test_tokens_equal_the_library_and_round_trip(spark):
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bpe.RANK_FILE), "rb"))}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    long = "It's  a test, isn't it?\n\n  12345 …漢字 🙂 \x1c " * 9000
    texts = [long, "", None, " ", "<|endoftext|>", "a" * 1000, "퟿ é"]
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, data string")
    encoded = bpe.encode_documents(spark, docs.drop("data"))
    got = {r.doc_id: r.token_ids for r in encoded.collect()}
    assert got == {i: plain.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert len(list(bpe.pieces(long))) > 3 and "".join(bpe.pieces(long)) == long
    back = {r.doc_id: bytes(r.data) for r in bpe.decode_documents(spark, encoded).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(texts)}


# --- pages ---


def test_lines_of_malformed_pages():
    free, article, gone = html_extract.FREE, html_extract.ARTICLE, html_extract.GONE
    assert html_extract.lines(None) == []
    assert html_extract.lines('<p>A &amp; B<br>C<p>D<script>if(a<b)"</p>"</script>E<!-- F -->') == [("A & B C", free), ("D E", free)]
    page = '<body><nav><a>m</a></nav><article><h1>T</h1><p><b>x<p class="ad">buy</p><div id="comments"><p>c</div><p>y</article><footer>f'
    assert html_extract.lines(page) == [("m", gone), ("T", article), ("x", article), ("c", gone), ("y", article), ("f", gone)]


def test_quotes_inside_tags():
    free = html_extract.FREE
    assert html_extract.lines("<p title=it's>A</p><p>don't</p>") == [("A", free), ("don't", free)]
    assert html_extract.lines('<p title="a>b" lang=\'c>d\'>A</p><p x="open>B</p>') == [("A", free), ("B", free)]
    assert html_extract.lines('<p data-id="nav">A</p><p id="nav">B</p>') == [("A", free)]
    assert html_extract.lines("<p>A</p>B <p a='" + "<p a=" * 50_000) == [("A", free), ("B", free)]


def test_markup_that_speaks_for_itself():
    text = lambda page: html_extract.main_text(html_extract.lines(page))
    assert text('<main><p>teaser</p><article class="post"><div class="post-header"><h1>T</h1></div><p>A</p><div class="notice">n</div></article></main>') == "T\nA"
    assert text('<div role="main"><p>A<form>f</form><p>B</div><p>outside') == "A\nB"
    assert text("<p>A<button>b<p>B &lt;i&gt; &eacute;&nbsp;x") == "A b\nB <i> é x"
    assert text("<p>A<style>b<p>B") == "A"
    assert text('<article><p>A</article><article class="comment"><p>c</article>') == "A"


def test_shared_lines_are_a_longest_common_subsequence():
    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            out = [0]
            for j, y in enumerate(b):
                out.append(row[j] + 1 if x == y else max(row[j + 1], out[j]))
            row = out
        return row[-1]

    r = random.Random(5)
    for _ in range(2000):
        a, b = (["".join(r.choice("abcd")) for _ in range(r.randint(0, 10))] for _ in "ab")
        found = sorted(html_extract.shared(a, b))
        rest = iter(b)
        assert len(found) == length(a, b) and all(any(a[i] == y for y in rest) for i in found)


# --- urls ---


def test_rules_and_classes(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "https://WWW.A.com/en/1?x=1#f", None),
        (2, "https://example.com/en/7x", ""),
        (3, "https://b.org/x", link.format("https://www.a.com/en/1?x=1")),
        (4, "https://c.org/y", '<meta http-equiv="refresh" content="0; url=https://b.org/x">'),
        (5, "https://d.org/z", link.format("https://c.org/y") + "<p>"),
        (6, "https://e.org/q", link.format("https://example.com/en/7x")),
        (7, None, link.format("https://b.org/x")),
        (8, "no scheme", None),
        (9, "https://xcom/en/1", None),
        (10, "https://sub.example.com/en/8", link.format("/en/7x")),
        (11, "http://b.org/x/?utm_source=q", None),
        (12, "https://free.org/p", link.format("//c.org/y")),
    ]
    pages = spark.createDataFrame([(*r, "n") for r in rows], "page_id long, url string, html string, node string")
    got = {r.page_id: tuple(r)[1:] for r in url_filters.judge(spark, pages.drop("node"), url_filters.RULES).collect()}
    assert got[1] == ("www.a.com", "/en/1", "com/en/", "block")
    assert got[2] == ("example.com", "/en/7x", "example.com/en/7", "allow")
    assert [got[k][3] for k in (3, 4, 5, 11, 12)] == ["block"] * 5 and got[3][2] is None
    assert got[6][3] == "allow" and got[7] == ("", "", None, "allow") and got[8] == ("", "", None, "allow")
    assert got[9] == ("xcom", "/en/1", None, "allow")
    assert got[10][2:] == ("com/en/", "block")


def test_rule_table_agrees_with_the_expression(spark):
    hosts = ["a.example.com", "example.com", "com", "b.net", "example.net", "x.org", "", "xcom"]
    urls = spark.createDataFrame([(i, h, p) for i, (h, p) in enumerate((h, p) for h in hosts for p in ["/en/7", "/en/", "/de/8x", "/es/", "", "/"])], "id long, host string, path string")
    rules = spark.createDataFrame([(r.host, r.path, r.allow) for r in url_filters.RULES], "host string, path string, allow boolean")
    m = url_filters.matched(F.col("host"), F.col("path"), url_filters.RULES)
    want = {tuple(r) for r in urls.withColumn("m", m).select("id", "m.rule", "m.allow").collect()}
    assert {(r.id, r.rule, r.allow) for r in url_filters.match_table(urls, rules).collect()} == want


# --- shards ---


def test_compaction_keeps_rows_and_versions(spark, tmp_path):
    tiers = sharding.Tiers(target=4000, small=100, fan_in=3)
    store = sharding.Store(spark, f"file://{tmp_path}/s", tiers)
    assert store.version() == 0 and store.manifest().count() == 0
    schema = spark.createDataFrame([], "doc_id long, text string, shard_note string").schema
    assert store.read(schema).count() == 0
    rows = [(i, None if i % 17 == 0 else "é" * (i % 40), "s") for i in range(300)]
    for k in range(6):
        store.append(spark.createDataFrame(rows[50 * k : 50 * k + 50], schema).repartition(3))
        while store.compact():
            pass
    store.append(spark.createDataFrame([], schema))
    live = store.manifest().collect()
    assert sum(r.n_rows for r in live) == 300 and sum(r.n_bytes for r in live) == sum(len((t or "").encode()) for _, t, _ in rows)
    by_tier = Counter(r.tier for r in live if r.n_bytes < r.n_shards * (tiers.target // 2))
    assert all(n < tiers.fan_in for n in by_tier.values()) and len(live) < 6
    assert sorted(map(tuple, store.read(schema).select("doc_id", "text", "shard_note").collect())) == rows
    old = store.read(schema, 1).count()
    assert old == 50
    version = store.version()
    with pytest.raises(Exception, match="(?i)exist"):
        store.commit(store.manifest(), version)
    # a run that another writer has not committed yet is spared, and so are old versions' runs
    store._write(spark.createDataFrame(rows[:5], schema))
    assert store.vacuum() == 0 and store.read(schema, 1).count() == 50
    assert store.vacuum(0) > 1 and store.version() == version
    assert store.read(schema).count() == 300


def test_arrivals_are_dealt_in_one_pass(spark):
    rows = [(None if i % 50 == 0 else i, None if i % 17 == 0 else "é" * (i % 40), 7) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _part int").repartition(6)
    store = sharding.build(spark, docs, sharding.Tiers(target=1 << 14, small=256, fan_in=3), 5)
    assert store.version() >= 5
    back = store.read(docs.schema)
    assert sorted(map(repr, back.select("doc_id", "text", "_part").collect())) == sorted(map(repr, docs.collect()))
    live = store.manifest().collect()
    assert sum(r.n_rows for r in live) == 400 and sum(r.n_bytes for r in live) == sum(len((t or "").encode()) for _, t, _ in rows)
    assert store.vacuum(0) <= 1 and store.read(docs.schema).count() == 400


# --- licences ---


def test_licences(spark):
    texts = [
        "Some words first.\nReleased under the MIT License.\nOther words",
        "Intro\n\n" + licenses._MIT.replace("\n", "\r\n"),
        licenses._APACHE.replace("Licensed", "licensed").replace("limitations", "limits"),
        None,
        "",
        "license",
        "This work is licensed under the GNU General Public License, version 2. Yes!",
        "the license of the house " * 3000,
    ]
    docs = spark.createDataFrame([(i, t, 0.1) for i, t in enumerate(texts)], "doc_id long, text string, dice double")
    got = {r.doc_id: r.matches for r in licenses.scan(spark, docs, ["doc_id"]).collect()}
    assert [[m.license for m in got[i]] for i in range(8)] == [["MIT"], ["MIT"], ["Apache-2.0"], [], [], [], ["GPL-2.0"], []]
    assert (got[0][0].start, got[0][0].stop, got[0][0].dice) == (3, 8, 1.0)
    assert 0.9 < got[2][0].dice < 1


def test_pipeline_stages_chain(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, item = prose(80), prose(15)
    texts = [prose(100), prose(60) + " " + shared + " " + prose(40), prose(70) + " " + shared, prose(50) + " " + item + " " + prose(30), "too short", None]
    texts.append(texts[0])
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns, name
    held = {x.doc_id: x.text for x in at.collect()}
    assert sorted(held) == [0, 1, 2, 3]
    assert held[1].split() == texts[1].split() and len(held[2].split()) == 70
    assert len(held[3].split()) == 80
    out = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(out) == [0, 1, 2, 3] and out[0].n_tokens == len(out[0].token_ids) > 100


def test_registered_names():
    from kbloom.llm import catalogue

    assert [n.split("_")[0] for n in catalogue.QUERIES] == [f"op{k}" for k in range(1, 14)]
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_blocks_of_languages_change_no_result(spark):
    r = random.Random(11)
    names = [f"l{k:03d}" for k in range(600)]
    held = []
    for name in names:
        own = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzäöüé") for _ in range(r.randint(2, 7))) for _ in range(6)]
        held.append((" ".join(own), name))
    rows = spark.createDataFrame(held, "text string, lang string")
    docs = spark.createDataFrame([(k, t, "x") for k, (t, _) in enumerate(held[::7])], "doc_id long, text string, score string")
    got = []
    for size in (256, 1000, 7):
        model = language_id.train(rows, size)
        assert model.langs == names and len(model.blocks) == -(-600 // size)
        found = language_id.predict(spark, docs.where("doc_id < 20"), model, ["doc_id", "score"])
        assert found.columns == ["lang_pred", "score", "lang_spans", "doc_id", "_kept_score"]
        got.append({x.doc_id: (x.lang_pred, x.score) for x in found.collect()})
    assert got[0] == got[1] == got[2]
    assert all(got[0][k][0] == names[7 * k] for k in got[0])


def test_narrowing_scores_and_held_out_accuracy(spark, model):
    import numpy as np

    words = ["house", "дом", "jardin", "garden", "漢字"]
    text = " ".join(words).encode()
    starts, ends, _, chars, script, _ = language_id._words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    scores = language_id._scores(model, chars, starts, ends, script)
    (block,) = model.tables()
    for i, word in enumerate(words):
        kind = next((k for k, (lo, hi) in enumerate(language_id.SCRIPTS, 1) if lo <= ord(word[0]) <= hi), 0)
        able = [bool(block.uses[kind][k]) for k in range(3)]
        # the same sums, gram by gram
        one = np.frombuffer(word.encode(), np.uint8)
        s, e, _, c, _, _ = language_id._words(one, np.array([0, len(one)]))
        two, three, _ = language_id._grams(c, s, e)
        plain = [sum(float(block.table[a][k]) + float(block.table[b][k]) for a, b in zip(two, three, strict=True)) for k in range(3)]
        top = max((p for p, ok in zip(plain, able, strict=True) if ok), default=0)
        want = [(p - top if ok else language_id.NOT_A_CANDIDATE) if any(able) else 0 for p, ok in zip(plain, able, strict=True)]
        assert scores[i].tolist() == pytest.approx(want, abs=1e-3)
    fresh = [(k, speech(w, 500 + k, 25), lang) for k, (w, lang) in enumerate([(EN, "en"), (FR, "fr"), (RU, "ru")] * 10)]
    found = language_id.predict(spark, spark.createDataFrame(fresh, "doc_id long, text string, lang string"), model, ["lang"], spans=False)
    assert found.where("lang_pred = lang").count() == len(fresh)
