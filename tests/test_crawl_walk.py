"""The crawl of many sites against a plain priority-queue crawl of each."""

import os
import random

import pytest
from oracle import SF_DIR
from pyspark.sql import functions as F

from kbloom.functions import urls
from kbloom.operators import crawl
from kbloom.plans import url_queries

#: Priorities of the classes that the made pages have.
KINDS = {"/": ("home", 100), "/about": ("about", 90), "/contact": ("contact", 88)}


def plain(origin, web, edges, listed, classes, budget, workers):
    """Requests (url, landed or None, ok, role) of one site in order, and all pages queued."""
    seen, queue, asked, fetched, n = {origin}, [], [], set(), 0

    def enqueue(url, anchor, bonus):
        nonlocal n
        if url in seen:
            return
        seen.add(url)
        role, priority = classes[url, anchor]
        n += 1
        queue.append((-(priority + bonus), n, url, role))

    def fetch(url, role):
        page, landed = web.get(url, (None, None))
        ok = page is not None and landed not in fetched
        asked.append((url, landed, ok, role))
        if ok:
            fetched.add(landed)
            seen.add(landed)
        return page if ok else None

    def harvest(page):
        for url, anchor, bonus in edges.get(page, []):
            enqueue(url, anchor, bonus)

    for url in listed:
        enqueue(url, "", 0)
    page = fetch(origin, "home")
    if page is not None:
        harvest(page)
    while True:
        room = min(workers, budget - len(fetched), 2 * budget - len(asked))
        queue.sort()
        batch, queue[:] = queue[: max(0, room)], queue[max(0, room) :]
        if not batch:
            return asked, seen, queue
        for page in [p for p in [fetch(url, role) for _, _, url, role in batch] if p is not None]:
            harvest(page)


def made(seed, sites=6):
    """Skewed random sites with cycles, dead links, redirects and repeated links."""
    r = random.Random(seed)
    web, edges, listed, seeds = [], [], [], []
    page = 0
    for s in range(sites):
        host = f"https://site{s}.com"
        n = 60 if s == 0 else r.randint(0, 12)
        paths = ["/"] + [r.choice(["/about", "/contact", f"/p{k}", f"/blog/p{k}", f"/a/b/c{k}"]) + ("" if k < 3 else f"-{k}") for k in range(n)]
        paths = list(dict.fromkeys(paths))
        names = [host + p for p in paths]
        seeds.append((f"site{s}", names[0]))
        for k, name in enumerate(names):
            if r.random() < 0.15:
                continue
            page += 1
            landed = names[0] if r.random() < 0.1 else (r.choice(names) if r.random() < 0.1 else name)
            web.append((name, landed, page))
            targets = r.sample(names, min(len(names), r.randint(0, 6))) + [host + f"/dead{r.randint(0, 9)}", "https://other.org/x"]
            for pos, t in enumerate(dict.fromkeys(targets)):
                edges.append((page, t, r.choice(["", "About us", "Contact", "x"]), r.choice([15, 8, 0]), pos))
            if r.random() < 0.3:
                listed.append((f"site{s}", name, k))
    return seeds, web, edges, listed


def expected(spark, seeds, web, edges, listed, budget, workers):
    pairs = {(u, a) for _, u, a, *_ in edges} | {(u, "") for _, u, _ in listed}
    held = spark.createDataFrame(sorted(pairs), "url string, anchor string")
    kind = urls.classify(F.col("url"), F.col("anchor"))
    classes = {(r.url, r.anchor): (r.role, r.priority) for r in held.select("url", "anchor", kind["role"].alias("role"), kind["priority"].alias("priority")).collect()}
    out = {}
    for site, origin in seeds:
        own = {}
        for page, url, anchor, bonus, first in sorted(edges, key=lambda e: (e[0], -e[3], e[4])):
            if url.split("/")[2].split(".")[-2:] == origin.split("/")[2].split(".")[-2:]:
                own.setdefault(page, []).append((url, anchor, bonus))
        mine = [u for s, u, _ in sorted(listed, key=lambda x: x[2]) if s == site]
        out[site] = plain(origin, {u: (p, w) for u, w, p in web}, own, mine, classes, budget, workers)
    return out


@pytest.mark.parametrize(("seed", "budget", "workers"), [(1, 20, 4), (2, 5, 1), (3, 8, 3)])
def test_walk_equals_a_plain_crawl(spark, seed, budget, workers):
    seeds, web, edges, listed = made(seed)
    frames = (
        spark.createDataFrame([*seeds, (None, "https://x.com"), ("none", None)], "site string, url string"), spark.createDataFrame(web, "url string, landed string, page_id long"),
        spark.createDataFrame(edges, "page_id long, url string, anchor string, bonus int, first int"), spark.createDataFrame(listed, "site string, url string, pos int"),
    )
    got = crawl.walk(spark, *frames, budget=budget, workers=workers)
    want = expected(spark, seeds, web, edges, listed, budget, workers)
    asked = {}
    for r in got.asked.orderBy("site", "round", "rank").collect():
        asked.setdefault(r.site, []).append((r.url, r.landed, r.ok, r.role))
    assert asked == {s: w[0] for s, w in want.items()}
    assert {(r.site, r.place, r.url) for r in got.pages().collect()} == {(s, k + 1, x[1]) for s, w in want.items() for k, x in enumerate([a for a in w[0] if a[2]])}
    for r in got.summary().collect():
        asked_, seen, queue = want[r.site]
        fetched = sum(a[2] for a in asked_)
        over = fetched >= budget and len(queue) > 0
        assert (r.fetched, r.requests, r.discovered, r.left_over) == (fetched, len(asked_), len(seen), len(queue) if over else 0)
        assert r.warning == ("budget-exceeded" if over else "empty-body" if fetched == 0 else None)


def test_walk_of_nothing(spark):
    none = [spark.createDataFrame([], s) for s in ("site string, url string", "url string, landed string, page_id long", "page_id long, url string, anchor string, bonus int, first int")]
    got = crawl.walk(spark, *none)
    assert got.pages().collect() == [] and got.summary().collect() == []


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_crawl_of_the_tables(spark):
    """All hosts of the pages table, pages and requests counted against the plain crawl."""
    got = url_queries.crawled(spark, SF_DIR)
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    named = pages.select("page_id", urls.normalize_url(F.col("url")).alias("url"), urls.host_of(F.col("url")).alias("site")).orderBy("page_id").collect()
    edges = [(r.page_id, r.url, r.anchor, r.bonus, r.first) for r in crawl.links(pages).collect()]
    seeds, web = {}, {}
    for r in named:
        seeds.setdefault(r.site, r.url)
        web.setdefault(r.url, (r.url, r.url, r.page_id))
    listed = [(r.site, r.url, r.page_id) for r in named]
    want = expected(spark, list(seeds.items()), list(web.values()), edges, listed, crawl.BUDGET, crawl.WORKERS)
    assert {(r.site, r.place, r.url) for r in got.pages().collect()} == {(s, k + 1, x[1]) for s, w in want.items() for k, x in enumerate([a for a in w[0] if a[2]])}
    assert {(r.site, r.requests) for r in got.summary().collect()} == {(s, len(w[0])) for s, w in want.items()}
