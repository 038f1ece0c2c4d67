"""Page differencing: neighbours decide, wherever the ranges are cut."""

import random

import pytest

from kbloom.llm import html_extract as H

SCHEMA = "page_id long, url string, html string, text string, host string, keep int"


def run(spark, pages, parts=3):
    df = spark.createDataFrame([(*p, "t", "h", 1) for p in pages], SCHEMA).repartition(parts)
    out = H.extract(df, ["page_id", "url", "text", "host", "keep"])
    assert out.columns == ["text", "page_id", "url", "_kept_text", "host", "keep"]
    assert {tuple(r) for r in out.select("_kept_text", "host", "keep").distinct().collect()} <= {("t", "h", 1)}
    return {r.page_id: r.text for r in out.collect()}


def story(k, name="Site name"):
    return f"<body><div><p>{name}</p><p>Home</p></div><div><p>Story {k} is here</p><p>More of the {k} story at some length</p></div><div><p>All rights reserved</p></div></body>"


def brute(pages):
    """The rule as a plain program over all pages at once."""
    by_host = {}
    for _, url, html in pages:
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        host, path = rest.split("/", 1)[0].lower(), "/" + rest.split("/", 1)[1] if "/" in rest else ""
        parsed = H.lines(html)
        live = [t for t, s in parsed if s not in (H.GONE, H.DOUBT)]
        by_host.setdefault(host, {}).setdefault(max(live, key=len, default=""), []).append((path, html or "", live))
    return by_host


def want(pages):
    by_host, out = brute(pages), {}
    for k, url, html in pages:
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        host = rest.split("/", 1)[0].lower()
        parsed = H.lines(html)
        mine = max((t for t, s in parsed if s not in (H.GONE, H.DOUBT)), key=len, default="")
        # copies stand at their smallest path
        first = {s: min(p for p in v) for s, v in by_host[host].items()}
        path = min(p for p, h, _ in by_host[host][mine] if h == (html or ""))
        order = sorted(first.items(), key=lambda x: x[1][0])
        at = [s for s, _ in order].index(mine)
        beside = [order[i][1] for i in (at - 1, at + 1) if 0 <= i < len(order)]
        out[k] = H.main_text(parsed, path, [(p, live) for p, _, live in beside])
    return out


@pytest.mark.parametrize("parts", [1, 4, 20])
def test_neighbours_are_exact_in_any_partitioning(spark, parts):
    r = random.Random(8)
    pages = []
    for k in range(160):
        host = r.choice(["one.example", "one.example", "two.example", f"h{k}.example"])
        body = story(r.randrange(70), r.choice(["Site name", "Site name", "Other name"]))
        pages.append((k, f"https://{host}/a/{r.randrange(100):03d}/{k}", body))
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = run(spark, pages, parts)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert got == want(pages)
    assert sum("rights" not in t for t in got.values()) > 80


def test_neighbours_decide(spark):
    alone = [(1, "https://h.example/a/1", story(1))]
    other = [(2, "https://h.example/a/2", story(2))]
    assert run(spark, alone)[1] == "Site name\nHome\nStory 1 is here\nMore of the 1 story at some length\nAll rights reserved"
    assert run(spark, alone + other)[1] == "Story 1 is here\nMore of the 1 story at some length"
    assert run(spark, alone + [(2, "https://k.example/a/2", story(2))])[1] == run(spark, alone)[1]
    # a link line in an article goes if the neighbour has it, other shared lines stay
    page = "<article><p>{}</p><p>Quoted by both</p><p> <a href='/s'>Share <b>this</b></a> </p><p>Read <a>on</a></p></article>"
    pair = [(1, "https://h.example/1", page.format("First line of its own")), (2, "https://h.example/2", page.format("Second line of its own"))]
    assert run(spark, pair)[1] == "First line of its own\nQuoted by both\nRead on"
    assert run(spark, pair[:1])[1] == "First line of its own\nQuoted by both\nShare this\nRead on"


def test_copies_are_not_their_own_neighbours(spark):
    copies = [(k, f"https://h.example/a/{k:02d}", story(1)) for k in range(6)]
    near = [(k, f"https://h.example/a/{k:02d}", story(1).replace("rights", f"rights {k}")) for k in range(6, 9)]
    got = run(spark, copies + near + [(20, "https://h.example/b", story(2)), (21, "https://h.example/b", story(2))])
    assert {got[k] for k in range(6)} == {"Story 1 is here\nMore of the 1 story at some length"}
    assert got[7] == "Story 1 is here\nMore of the 1 story at some length\nAll rights 7 reserved"
    assert got[20] == got[21] == "Story 2 is here\nMore of the 2 story at some length"
    # two equally near neighbours: the earlier one
    three = [(1, "https://e.example/1", "<p>x<p>left<p>one"), (2, "https://e.example/2", "<p>left<p>middle<p>right"), (3, "https://e.example/3", "<p>y<p>right<p>three")]
    assert run(spark, three)[2] == "middle\nright"


def test_nulls_and_long_pages(spark):
    long = "".join(f"<p>line {k}</p>" for k in range(60_000))
    pages = [(1, None, None), (2, "", ""), (3, "no host", "<p>a"), (4, "https://l.example/1", long), (5, "https://l.example/2", long + "<p>end"), (6, "https://m.example/", "<p>" + "w " * 1_000_000)]
    got = run(spark, pages)
    assert got[1] == got[2] == "" and got[3] == "a"
    assert got[4].count("\n") == 59_999 and got[5].endswith("end") and len(got[6]) == 1_999_999


def test_layout_names_around_an_article():
    text = lambda page: H.main_text(H.lines(page))
    for name in ("page with-sidebar", "no-comments", "has-header", "search-results", "layout sidebar-left", "withMenu", "header-wrap"):
        assert text(f'<div class="{name}"><p>menu</p><article><p>A</p></article></div>') == "A", name
        assert text(f'<div id="{name}"><main><p>A</p></main></div>') == "A", name
    assert text('<div class="related"><article><p>teaser</p></article></div><article><p>A</p></article>') == "A"
    assert text('<div class="comments"><article><p>c</p></article></div><p>A</p>') == "A"
    assert text('<div class="no-sidebar"><p>A</p></div><div class="site-sidebar"><p>s</p></div>') == "A"
    assert text("<div class=sidebar><nav><article>x</article></nav></div><p>A</p>") == "A"
