"""Operators on small tables: folds, stores, crawls, extraction."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kbloom.functions import fields
from kbloom.operators import crawl, dom, extract, pages, reconcile, scoring, store, versions

CLAIM = "site long, path string, seq long, value string, method string, role string, confidence double, url string, note string"


def claim(seq, value, method, role="home", url=None, note=None, site=1):
    return (site, "p", seq, value, method, role, fields.METHODS[method][1], url or f"u{seq}", note)


def test_scalar_precedence_and_conflict(spark):
    rows = [claim(1, "A", "dom"), claim(2, "b", "json-ld"), claim(3, " B ", "json-ld", "contact"), claim(4, "c", "json-ld", "blog-post")]
    got = reconcile.scalars(spark.createDataFrame(rows, CLAIM)).first()
    assert (got.value, got.n_values, got.confidence, got.urls) == (" B ", 2, 0.45, "u3|u2")
    assert got.note == "We found 2 different values: c"
    alone = reconcile.scalars(spark.createDataFrame([claim(1, "x", "dom", note="seen")], CLAIM)).first()
    assert (alone.note, alone.confidence) == ("seen", 0.65)


def test_record_fold_inherits_before_lower_ranks(spark):
    """A top claim without a value keeps what it displaced, not a later claim's."""
    rows = [(1, "p", "k", 1, "heuristic", "home", 0.45, "u", "a"), (1, "p", "k", 2, "computed", "home", 0.7, "u", None), (1, "p", "k", 3, "dom", "home", 0.65, "u", "b")]
    df = spark.createDataFrame(rows, "site long, path string, key string, seq long, method string, role string, confidence double, url string, x string")
    got = reconcile.fold_records(df, ["x"]).first()
    assert (got.x, got.method) == ("a", "derived")


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 10_000))
def test_record_fold_equals_a_plain_fold(spark, seed):
    r = random.Random(seed)
    rows = [(r.randint(1, 3), "p", r.choice("kl"), i, r.choice(list(fields.METHODS)), r.choice(list(fields.ROLE_WEIGHTS)), r.choice([None, "", "a", "b"]), r.choice([None, "", "c", "d"])) for i in range(40)]
    df = spark.createDataFrame([(*x[:6], fields.METHODS[x[4]][1], f"u{x[3] % 4}", *x[6:]) for x in rows], "site long, path string, key string, seq long, method string, role string, confidence double, url string, x string, y string")
    want = {}
    for site, _, key, _, method, role, x, y in rows:
        tier, confidence = fields.METHODS[method]
        rank = (tier, confidence * fields.ROLE_WEIGHTS[role])
        base = want.get((site, key))
        if base is None:
            want[site, key] = (rank, x, y)
        elif rank > base[0]:
            want[site, key] = (rank, x or base[1] if x in (None, "") else x, y or base[2] if y in (None, "") else y)
        else:
            want[site, key] = (base[0], x if base[1] in (None, "") else base[1], y if base[2] in (None, "") else base[2])
    got = {(g.site, g.key): (g.x, g.y) for g in reconcile.fold_records(df.repartition(r.randint(1, 5)), ["x", "y"]).collect()}
    assert got == {k: v[1:] for k, v in want.items()}


def test_lists_keep_the_best_spelling(spark):
    rows = [claim(1, "wells", "dom"), claim(2, " Wells ", "json-ld"), claim(3, "Pumps", "dom"), claim(4, "", "dom")]
    got = reconcile.lists(spark.createDataFrame(rows, CLAIM)).first()
    assert (got["items"], got.urls, got.confidence) == ("Wells|Pumps", "u2|u3", 0.8)


def test_dom_closes_what_pages_leave_open():
    root = dom.parse('<p>a<p>b<b>c<div>d</div><ul><li>x<li>y</ul><script>"</p>"</script><br>&copy;')
    assert [n.text() for n in root.find("p")] == ["a", "bc"]
    assert [n.text() for n in root.find("li")] == ["x", "y"]
    assert root.text(apart=True) == "a bc d x y ©"
    assert dom.parse(None).text() == ""
    assert dom.anchors('<nav><a href="/a">A</a></nav><a href="">no</a><footer><a href="/f">F</a></footer><a href="/b">B') == [("/a", "A", "nav"), ("/f", "F", "footer"), ("/b", "B", "body")]


def test_links_keep_the_best_place(spark):
    html = '<nav><a href="/s/">S</a></nav><p><a href="https://www.x.com/s">A longer name</a><a href="tel:1">t</a><a href="/f.pdf">f</a>'
    got = crawl.links(spark.createDataFrame([(1, "https://x.com/", html), (2, None, None)], "page_id long, url string, html string")).collect()
    assert [(r.url, r.anchor, r.bonus) for r in got] == [("https://x.com/s", "S", 15)]


def test_failing_extractor_loses_its_own_claims_only(spark, monkeypatch):
    html = '<a href="tel:+1 (512) 273-7389">call</a><a href="mailto:Me@x.io?subject=1">m</a><meta name="description" content="' + "d" * 50 + '">'
    rows = spark.createDataFrame([(1, "https://x.io/", "home", html), (2, "https://x.io/b", "home", None)], "page_id long, url string, role string, html string")
    got = {(r.path, r.value, r.method) for r in extract.claims(rows).collect()}
    assert ("foundation.phone", "512-273-7389", "dom") in got and ("foundation.email", "me@x.io", "dom") in got and ("foundation.overview", "d" * 50, "meta") in got
    quotes = "<div class='testimonials'><div class='testimonial'>They drilled our well in a day, and it was great.</div></div><blockquote>short</blockquote>"
    root = dom.parse(quotes)
    assert [v["quote"] for _, v, _, _ in extract.testimonials(root, {})] == ["They drilled our well in a day, and it was great."]


def test_budget_and_quotes(spark):
    docs = spark.createDataFrame([("s", i, 40) for i in range(5)], "site string, doc int, n int")
    assert [r.take for r in pages.excerpts(docs, "site", "doc", 100).orderBy("doc").collect()] == [40, 40, 20]
    quotes = spark.createDataFrame([(1, "ell one two three fo"), (2, "two three"), (3, "not there at all here")], "item_id long, q string")
    texts = spark.createDataFrame([(1, "well one two three four"), (2, "one two three")], "doc_id long, t string")
    assert sorted(tuple(r) for r in pages.verbatim(quotes, texts).collect()) == [(1, 1), (2, 1), (2, 2)]


def test_short_quotes_as_by_brute_force(spark):
    import random

    r = random.Random(5)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 12)))
    texts = [" ".join(word() for _ in range(r.randint(0, 30))) for _ in range(30)]
    quotes = []
    for _ in range(200):
        t = r.choice(texts)
        a = r.randrange(len(t) + 1)
        quotes.append(t[a : a + r.randint(pages.LEAST_QUOTE, 40)].strip())
    quotes = [q for q in quotes if len(q) >= pages.LEAST_QUOTE] + ["abcabcabcabc zz", "zzzzzzzzzzz", ""]
    found = pages.verbatim(spark.createDataFrame(list(enumerate(quotes)), "item_id long, q string"), spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string"))
    assert sorted(tuple(x) for x in found.collect()) == [(i, d) for i, q in enumerate(quotes) for d, t in enumerate(texts) if q and q in t]


@pytest.mark.parametrize("sent", [pages.SENT_QUOTES, 0])
def test_quotes_sent_or_shuffled(spark, monkeypatch, sent):
    monkeypatch.setattr(pages, "SENT_QUOTES", sent)
    quotes = [(1, "ell one two three fo"), (2, "two three"), (2, "not there at all here"), (3, "one two threads"), (4, "well one"), (5, "onetwothree"), (6, None)]
    texts = [(1, "well one two three four well one two three four"), (1, "one two three"), (2, None), (3, ""), (4, "xonetwothreex")]
    found = pages.verbatim(spark.createDataFrame(quotes, "item_id long, q string"), spark.createDataFrame(texts, "doc_id long, t string"))
    assert sorted(tuple(x) for x in found.collect()) == sorted((i, d) for i, q in quotes for d, t in texts if q and t and q in t)


def test_diff_and_apply_round_trip(spark):
    before = spark.createDataFrame([(1, "a", ["x"]), (1, "b", []), (1, "c", ["y", "z"])], "doc long, path string, lines array<string>")
    after = spark.createDataFrame([(1, "a", ["x"]), (1, "b", ["n"]), (1, "c", ["z", "w"])], "doc long, path string, lines array<string>")
    changes = versions.diff(before, after)
    assert {r.path: r.kind for r in changes.collect()} == {"a": "unchanged", "b": "added", "c": "changed"}
    assert {r.path: r.lines for r in versions.apply(changes, ["a", "b", "c"]).collect()} == {r.path: r.lines for r in after.collect()}
    assert {r.path: r.lines for r in versions.apply(changes, []).collect()} == {r.path: r.lines for r in before.collect()}
    lines = changes.where("path = 'c'").select(F.inline(versions.line_diff(F.col("old"), F.col("new")))).collect()
    assert [tuple(r) for r in lines] == [("z", "same"), ("w", "added"), ("y", "removed")]


def test_replayed_edits(spark):
    log = [(1, 1, "set", "a", "1"), (1, 2, "add", "l", "x"), (1, 3, "add", "l", "y"), (1, 4, "remove", "l", "x"), (1, 5, "undo", None, None), (1, 6, "saved", None, None), (1, 7, "set", "a", "2"), (1, 8, "set", "b", "3"), (1, 9, "revert", "a", None), (1, 10, "accept", "l", None)]
    got = versions.replay(spark.createDataFrame(log, "doc long, seq long, action string, field string, value string")).first()
    assert json.loads(got.draft) == {"a": "1", "b": "3", "l": ["x", "y"]}
    assert (got.reviewed, got.dirty) == ("b|l", "b")


def test_store_appends_versions(spark, tmp_path):
    held = store.Store(spark, str(tmp_path / "kb"))
    make = lambda rows: spark.createDataFrame(rows, "org string, doc string, saved_at string, document string").withColumn("saved_at", F.col("saved_at").cast("timestamp_ntz"))
    held.save(make([("o", "a", "2024-01-01", '{"n": 1, "people": [{"name": "P", "title": null}]}'), ("o", "b", "2024-01-01", "{}"), ("o", "c", "2024-01-01", "not json"), ("o", "d", "2024-01-01", "[1]")]))
    held.save(make([("o", "a", "2024-01-02", '{"n": 2, "people": [{"name": "Q", "title": "t"}, {"name": "R"}]}')]))
    assert sorted((r.doc, r.version) for r in held.versions().collect()) == [("a", 1), ("a", 2), ("b", 1)]
    current = {r.doc: json.loads(r.document).get("n") for r in held.current().collect()}
    assert current == {"a": 2, "b": None}
    rows = store.project(held.current(), "people", "name string, title string").orderBy("position").collect()
    assert [(r.doc, r.position, r.name, r.title) for r in rows] == [("a", 0, "Q", "t"), ("a", 1, "R", None)]


def test_greedy_matching_as_by_a_plain_pass(spark):
    import random
    import re

    def plain(x):
        return re.sub("[^a-z0-9]+", " ", re.sub("['’]", "", x.lower())).strip()

    def equal(a, b):
        x, y = plain(a), plain(b)
        s, t = ({w for w in v.split() if len(w) > 1 and w not in scoring.IGNORED} for v in (x, y))
        return bool(x and y) and (x in y or y in x or bool(s and t) and len(s & t) / min(len(s), len(t)) >= 0.6)

    r = random.Random(3)
    word = lambda: r.choice("well pump drill Pump's the and of co repair tank a deep".split())
    rows, want = [], {}
    for k in range(80):
        lists = [[" ".join(word() for _ in range(r.randint(0, 4))) for _ in range(r.randint(0, 6))] for _ in "eg"]
        rows.append((str(k), "f", *lists))
        free, n = list(lists[1]), 0
        for w in lists[0]:
            i = next((i for i, h in enumerate(free) if equal(w, h)), None)
            if i is not None:
                free.pop(i)
                n += 1
        want[str(k)] = (n, len(lists[0]), len(lists[1]))
    got = scoring.greedy(spark.createDataFrame(rows, "site string, field string, expected array<string>, produced array<string>"))
    assert {x.site: (x.matched, x.expected, x.produced) for x in got.collect()} == want


def test_greedy_matching(spark):
    rows = [("s", "f", ["Well Drilling", "Drilling", "Pump"], ["well drilling inc", "Pumps", "none"]), ("s", "g", [], ["x"])]
    got = scoring.greedy(spark.createDataFrame(rows, "site string, field string, expected array<string>, produced array<string>")).collect()
    assert [(r.field, r.matched, r.expected, r.produced) for r in got] == [("f", 2, 3, 3), ("g", 0, 0, 1)]


@pytest.mark.parametrize("parts", [1, 7])
def test_results_don_t_depend_on_partitions(spark, parts):
    rows = [claim(i, f"v{i % 5}", list(fields.METHODS)[i % 6], list(fields.ROLE_WEIGHTS)[i % 13], f"u{i % 3}", site=i % 4) for i in range(200)]
    df = spark.createDataFrame(rows, CLAIM).repartition(parts)
    got = sorted(map(tuple, reconcile.scalars(df).drop("candidates").collect()))
    assert got == sorted(map(tuple, reconcile.scalars(spark.createDataFrame(rows, CLAIM)).drop("candidates").collect()))


DOCUMENT = {
    "companyName": {"value": "Acme", "method": "scraped", "confidence": 0.9},
    "foundation": {"altNames": {"value": [], "method": "scraped", "confidence": 0.5}, "phone": {"value": " ", "method": "scraped", "confidence": 0.5}, "email": {"value": None, "method": "not-found", "confidence": 0, "note": "n"}},
    "people": {"value": [{"id": "1", "name": "P", "confidence": 0.7}, {"id": "2", "name": "Q"}], "method": "scraped", "confidence": 0.7},
    "quality": {"conflicts": [{"path": "companyName", "label": "Name", "resolved": False}]},
}


def test_projections_rebuild_to_the_same_rows(spark, tmp_path):
    documents = spark.createDataFrame([("a", 1, json.dumps(DOCUMENT)), ("b", 1, "{}"), ("c", 1, None)], "doc string, version int, document string")
    held = store.Store(spark, str(tmp_path / "kb"))
    held.save(documents.select(F.lit("o").alias("org"), "doc", F.lit("2024-01-01").cast("timestamp_ntz").alias("saved_at"), "document"))
    first = held.rebuild()
    assert first["people"] == (0, 2) and first["conflicts"] == (0, 1) and first["awards"] == (0, 0)
    again = held.rebuild()
    assert all(removed == written == first[name][1] for name, (removed, written) in again.items())
    got = {r.path: (r.value_present, r.is_filled, r.note) for r in store.provenance(documents).collect()}
    assert got == {"companyName": (True, True, None), "foundation.altNames": (True, False, None), "foundation.phone": (True, False, None), "foundation.email": (False, False, "n"), "people": (True, True, None)}
    assert {p for p, _ in store.PROJECTIONS.values()} & {"people.value", "quality.conflicts"}


def test_generated_lists_and_prices(spark):
    from kbloom.operators import enrich

    df = spark.createDataFrame([(["A"], [" a ", "b", "B", ""]), (None, ["x"]), (["A"], None)], "h array<string>, m array<string>")
    assert [r[0] for r in df.select(enrich.extend_list(F.col("h"), F.col("m"))).collect()] == [["A", "b"], ["x"], ["A"]]


def test_site_files(spark, tmp_path):
    from kbloom.sources import scratch, site_files

    xml = "<urlset><url><loc>https://x.com/a?b=1&amp;utm_source=q</loc><lastmod>2024</lastmod></url><!-- <url><loc>https://x.com/no</loc></url> --><url><loc>ftp://x.com/</loc></url><url></url></urlset>"
    got = site_files.sitemap_entries(spark.createDataFrame([("s", xml), ("t", None)], "source string, xml string")).collect()
    assert [(r.url, r.modified, r.is_index) for r in got] == [("https://x.com/a?b=1", "2024", False)]
    files = spark.createDataFrame([("s", xml)], "source string, xml string")
    none = site_files.discover(spark.createDataFrame([(1, "https://y.com/", "s")], "site long, origin string, source string"), files, scratch.cutter(spark, "t"))
    assert none.collect() == []
