"""HTML extraction by nearest-URL page differencing.

Pages of a host are put in order of URL path and each is paired with the nearest
pages before and after it.  The text lines of a pair are aligned by longest
common subsequence; lines that a page shares with its nearer neighbour are the
site's furniture and are deleted.  Markup then settles what differencing leaves
open.  Furniture that varies from page to page isn't shared: lines in furniture
elements go, and so do lines beside an article or main element.  Articles share
lines too (they quote, repeat and copy each other): inside an article or main
element a shared line goes only if all its text is a link.

Copies of a page share every line with it, so they are no neighbours of each
other: pages of a host with the same longest line are one story, a story stands
at the smallest of its paths, and neighbours are the stories before and after.
A neighbour that shares four fifths of a page's lines nevertheless is a copy
with a changed passage, and the other neighbour takes its place.

Pages are parsed where they are read.  What is sorted are line hashes: ranges of
host and path are written, each range gets the last story of the range before
and the first of the range after, and neighbours are found range by range, so the
result doesn't depend on the partitioning and a host of any size is spread.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kbloom.llm._io import Scratch, shielded, table

# Elements by what they mean for the text around them.
RAW = ["script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video", "head", "title", "textarea", "select", "button", "datalist"]
FURNITURE = ["nav", "footer", "aside", "form", "menu", "dialog", "header"]
BLOCKS = [
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html",
    "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead",
    "tr", "ul",
]
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
#: Words of class, id and role attributes that mark furniture and all inside it.
FURNITURE_WORDS = [
    "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "cookie", "cookies", "consent", "gdpr",
    "comments", "comment", "disqus", "related", "recommended", "share", "sharing", "social", "newsletter", "subscribe", "signup",
    "popup", "breadcrumb", "breadcrumbs", "pagination", "pager",
]
#: Words that mark furniture unless an article or main element stands inside: layouts are named by them too.
LAYOUT_WORDS = [
    "banner", "notice", "alert", "sidebar", "menu", "nav", "navbar", "navigation", "masthead", "footer", "header", "modal", "overlay",
    "widget", "skip", "contentinfo", "complementary", "search",
]
#: A name that begins so says what an element has or lacks, not what it is; so does one that ends so.
MODIFIERS = ["with", "without", "no", "not", "non", "has", "hide", "show"]
STATES = ["open", "opened", "closed", "enabled", "disabled", "on", "off", "count", "allowed", "status"]
#: Words that may stand beside a furniture word in the name of furniture; social-sciences is no such name.
NEUTRAL = [
    "list", "item", "items", "box", "bar", "block", "area", "zone", "slot", "unit", "row", "col", "column", "grid", "wrap", "wrapper", "container", "content", "inner", "outer", "body",
    "link", "links", "button", "buttons", "btn", "icon", "icons", "media", "image", "img", "label", "title", "text", "section", "panel", "card", "cards", "group", "set", "holder",
    "post", "posts", "article", "articles", "story", "stories", "news", "page", "site", "blog", "top", "bottom", "left", "right", "center", "main", "side", "inline", "sticky", "fixed", "float",
    "form", "input", "field", "reply", "respond", "thread", "author", "meta", "date", "avatar", "message", "dialog", "policy", "banner", "notice", "bottom", "square", "leaderboard", "skyscraper",
    "mpu", "dfp", "gpt", "google", "adsense", "facebook", "twitter", "instagram", "linkedin", "email", "mail", "print", "follow", "like", "us", "this", "more", "next", "prev", "previous", "up", "down",
    "small", "large", "big", "mobile", "desktop", "primary", "secondary", "container", "js", "wp", "c", "m", "l", "o", "u", "the", "by", "for", "to", "and", "in", "of", "a",
]
#: Words that mark reader comments, whatever stands inside.
COMMENT_WORDS = ["comment", "comments", "disqus"]

_RAW, _FURNITURE, _BLOCKS, _VOID, _WORDS, _LAYOUT, _MODIFIERS = map(frozenset, (RAW, FURNITURE, BLOCKS, VOID, FURNITURE_WORDS, LAYOUT_WORDS, MODIFIERS))
_STATES, _COMMENTS, _BESIDE = frozenset(STATES), frozenset(COMMENT_WORDS), frozenset([*FURNITURE_WORDS, *LAYOUT_WORDS, *NEUTRAL])
#: Comments, declarations and tags; a quote opens a value only after an equals sign.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)", re.S)
_NAMED = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_ROLE_MAIN = re.compile(r"""(?<![\w-])role\s*=\s*["']?main\b""", re.I)
_SPACE = re.compile(r"\s+")

#: States of a line; DOUBT is gone too, but an article or main element inside it is not.
FREE, ARTICLE, GONE, MAIN, DOUBT = 0, 1, 2, 3, 4
#: Added to the state of a line in an article or main element whose text is all in links.
LINKED = 8
#: Words that mark furniture of a page but not of an article.
_PAGE_ONLY = frozenset({"header", "banner", "masthead", "search", "skip"})
#: A neighbour that shares so large a part of a page's lines is a copy of it.
COPY = (4, 5)


def _names(attributes: str):
    """The words of each name in class, id and role that says what an element is."""
    for m in _NAMED.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", name).lower()) if w]
            if words and words[0] not in _MODIFIERS and words[-1] not in _STATES:
                yield words


def _furniture_name(words: list[str]) -> bool:
    """Whether a name has a furniture word, and none beside it that makes it the name of something else."""
    return not _WORDS.isdisjoint(words) and all(w in _BESIDE or w.isdigit() or len(w) > 20 for w in words)


def _comments(attributes: str) -> bool:
    """Whether an element holds reader comments."""
    return any(not _COMMENTS.isdisjoint(words) and _furniture_name(words) for words in _names(attributes))


def _marked(attributes: str, inside: bool) -> int:
    """GONE, DOUBT or FREE by the names in class, id and role; inside an article fewer words do."""
    out = FREE
    for words in _names(attributes):
        if _furniture_name(words):
            return GONE
        if not (_LAYOUT - _PAGE_ONLY if inside else _LAYOUT).isdisjoint(words):
            out = DOUBT
    return out


def lines(page: str | None) -> list[tuple[str, int]]:
    """The text blocks of a page in order, each with its state.

    A page whose every article and main element stands inside furniture by name
    is read again with these elements as they are, unless they are comments: a
    page's only article is never dropped for what its wrapper is called.
    """
    out = _lines(page, False)
    if page and not any(s & ~LINKED in (ARTICLE, MAIN) for _, s in out) and re.search(r"<(?:article|main)\b|role\s*=\s*[\"']?main\b", page, re.I):
        again = _lines(page, True)
        if any(s & ~LINKED in (ARTICLE, MAIN) for _, s in again):
            return again
    return out


def _lines(page: str | None, lenient: bool) -> list[tuple[str, int]]:
    """`lines` in one pass; if lenient, articles count in all furniture but comments.

    Unclosed elements reach to the end of what encloses them; an end tag without
    a start is ignored; text of raw elements and comments is no line.  A script,
    style, title or text area without an end reaches to the page's end, and so
    does a tag that the page's end cuts off.
    """
    page = page or ""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []  # open containers, and the state outside each
    state, at, end = FREE, 0, len(page)
    link, plain = False, False  # inside a link; text of this line outside links
    unclosed: set[str] = set()  # names without an end tag in the rest of the page

    def flush() -> None:
        nonlocal plain
        if text:
            line = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if line:
                out.append((line, state + LINKED * (state in (ARTICLE, MAIN) and not plain)))
            text.clear()
        plain = False

    def closing(name: str, other: str = ""):
        if name in unclosed:
            return None
        found = re.compile(rf"</{re.escape(name)}\s*>{other}", re.I).search(page, at)
        if found is None:
            unclosed.add(name)
        return found

    while at < end:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            text.append(page[at:stop])
            plain = plain or not (link or text[-1].isspace())
        if m is None:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name == "a":
            link = not m[1]
            continue
        if m[1]:
            if name in _BLOCKS:
                flush()
                k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
                if k is not None:
                    state = stack[k][1]
                    del stack[k:]
            continue
        if name in _RAW:
            if name == "title" or name == "head" or not m[3].endswith("/"):
                close = closing(name, r"|<body\b" if name == "head" else "")
                if close is None and name in ("script", "style", "title", "textarea"):
                    at = end
                elif close is not None:
                    at = close.start() if close[0].lower().startswith("<body") else close.end()
            text.append(" ")
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in _BLOCKS:
            flush()
        if name in _VOID:
            continue
        inside = state in (ARTICLE, MAIN)
        main = name == "main" or _ROLE_MAIN.search(m[3]) is not None
        if name in ("html", "body") or main:
            furniture = FREE
        elif name == "article":
            furniture = GONE if _comments(m[3]) or not lenient and _marked(m[3], True) == GONE else FREE
        elif name in _FURNITURE and not (name == "header" and state == ARTICLE):
            furniture = GONE
        else:
            furniture = _marked(m[3], inside)
            if lenient and furniture == GONE and not _comments(m[3]):
                furniture = DOUBT
        if name in _BLOCKS and name not in ("p", "li", "dd", "dt", "td", "th", "tr", "h1", "h2", "h3", "h4", "h5", "h6"):
            stack.append((name, state))
            if furniture == GONE or furniture == DOUBT and state != GONE:
                state = furniture
            elif name == "article" and state != GONE:
                state = ARTICLE
            elif main and state in (FREE, DOUBT):
                state = MAIN
        elif furniture:
            # a furniture paragraph, item or span: to its own end tag
            close = closing(name)
            at = close.end() if close else at
    flush()
    return out


def shared(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence of both line lists.

    Equal ends are matched first; the middle is aligned over the lines that
    occur in both, with the bit-parallel row recurrence kept for trace-back.
    """
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    tail = 0
    while tail < min(len(a), len(b)) - lo and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    found = set(range(lo)) | set(range(len(a) - tail, len(a)))
    mid_a, mid_b = a[lo : len(a) - tail], b[lo : len(b) - tail]
    common = set(mid_a) & set(mid_b)
    x = [i for i, t in enumerate(mid_a) if t in common]
    y = [t for t in mid_b if t in common]
    if not x:
        return found
    places: dict[str, int] = {}
    for j, t in enumerate(y):
        places[t] = places.get(t, 0) | 1 << j
    full = (1 << len(y)) - 1
    row, rows = full, []
    for i in x:
        hit = row & places[mid_a[i]]
        row = (row + hit | row - hit) & full
        rows.append(row)
    # a zero bit j of a row: the LCS grows with y[j]; walk back from the corner
    j = len(y)
    for k in range(len(x) - 1, -1, -1):
        above = rows[k - 1] if k else full
        low = (1 << j) - 1
        n_here, n_above = (~rows[k] & low).bit_count(), (~above & low).bit_count()
        if n_here > n_above:
            found.add(lo + x[k])
            # the match lies at the last position of this line that keeps the length
            own = places[mid_a[x[k]]] & low
            while own:
                p = own.bit_length() - 1
                if (~above & ((1 << p) - 1)).bit_count() == n_here - 1:
                    break
                own &= ~(1 << p)
            j = p
    return found


def _nearness(a: str, b: str) -> int:
    """Length of the common prefix of two paths."""
    n = min(len(a), len(b))
    k = 0
    while k < n and a[k] == b[k]:
        k += 1
    return k


def kept(own: list, states: list[int], path: str, beside: list[tuple[str, list]]) -> list[bool]:
    """Which lines of a page stay, given its neighbours as (path, lines).

    ``own`` and the neighbours' lines are texts or hashes of them, in order.
    The neighbour with the longer common path prefix is the nearer one, the
    earlier if equal.
    """
    lively = [i for i, s in enumerate(states) if s not in (GONE, DOUBT)]
    live, gone = [own[i] for i in lively], set()
    for _, other in sorted(beside, key=lambda x: -_nearness(x[0], path)):
        both = shared(live, other)
        if COPY[1] * len(both) < COPY[0] * len(live):
            gone = {lively[i] for i in both}
            break
    speaks = next((s for s in (ARTICLE, MAIN) if s in states or s + LINKED in states), FREE)
    inside = [i for i in lively if states[i] in (speaks, speaks + LINKED)]
    if speaks != FREE:
        gone = {i for i in gone if states[i] == speaks + LINKED}
    # a page of nothing but shared lines keeps them
    stay = [i for i in inside if i not in gone] or inside
    out = [False] * len(own)
    for i in stay:
        out[i] = True
    return out


def main_text(own: list[tuple[str, int]], path: str = "", beside: list[tuple[str, list[str]]] = ()) -> str:
    """The kept lines of a parsed page, given its neighbours as (path, lines)."""
    stay = kept([t for t, _ in own], [s for _, s in own], path, list(beside))
    return "\n".join(t for (t, _), k in zip(own, stay, strict=True) if k)


def _outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Host, path and digest of each page, its line hashes and states, and its story."""
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        hashes, states, stories = [], [], []
        for page in batch.column(3):
            parsed = lines(page.as_py())
            lively = [t for t, s in parsed if s not in (GONE, DOUBT)]
            hashes.append(np.array([digest(t) for t, _ in parsed], np.uint64).view(np.int64))
            states.append(np.array([s for _, s in parsed], np.int8))
            stories.append(digest(max(lively, key=len, default="")))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(np.array(stories, np.uint64).view(np.int64)), pa.array(hashes, pa.list_(pa.int64())), pa.array(states, pa.list_(pa.int8()))],
            ["host", "path", "page", "story", "hashes", "states"],
        )


def _flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which lines of each page stay, from its neighbours' line hashes."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            beside = [(x["path"], x["live"]) for x in (r["before"], r["after"]) if x is not None]
            out.append(kept(r["hashes"], r["states"], r["path"], beside))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.bool_()))], ["host", "page", "keep"])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[t for t, _ in lines(page.as_py())] for page in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), *batch.columns[1:]], ["_lines", *batch.schema.names[1:]])


def _neighbours(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, story, before, after): the stories next to each one, with their lines.

    Ranges are written, so their numbers hold if an executor is lost.  A range's
    first and last story go to the ranges beside it; they are one row a range.
    """
    live = F.transform(F.filter(F.arrays_zip("hashes", "states"), lambda x: ~x["states"].isin(GONE, DOUBT)), lambda x: x["hashes"])
    first = F.min_by(F.struct("path", live.alias("live")), F.struct("path", "page"))
    stories = pages.groupBy("host", "story").agg(first.alias("at")).select("host", "at.path", "story", "at")
    order = ["host", "path", "story"]
    ranges = scratch.save(stories.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()), "ranges")
    key = F.struct(*order)
    ends = ranges.groupBy("range").agg(F.min_by(F.struct(*order, "at"), key).alias("low"), F.max_by(F.struct(*order, "at"), key).alias("high"))
    # one row for each range: the ranges beside it, past empty ones
    beside = Window.orderBy("range")
    ends = ends.select("range", "low", "high", F.lead("range").over(beside).alias("next"), F.lag("range").over(beside).alias("last"))
    halo = ends.select(F.col("next").alias("range"), "high.*").unionByName(ends.select(F.col("last").alias("range"), "low.*")).where("range is not null")
    rows = ranges.withColumn("own", F.lit(True)).unionByName(halo.withColumn("own", F.lit(False)))
    near = Window.partitionBy("range").orderBy(*order)
    same = lambda step: F.when(step("host").over(near) == F.col("host"), step("at").over(near))
    return rows.select("host", "story", "own", same(F.lag).alias("before"), same(F.lead).alias("after")).where("own").drop("own")


def extract(pages: DataFrame, others: list[str]) -> DataFrame:
    """text and the columns ``others`` of every page.

    ``pages`` holds url and html.  A null or empty html gives an empty text; a
    page whose URL is null or has no host is compared with others like it.  Of
    two neighbours the one with the longer common path prefix is the nearer, the
    earlier one if equal.  Repeated rows and copies get the same text.  A column
    of ``others`` that is itself called text is ``_kept_text``.
    """
    scratch = Scratch(pages.sparkSession, "html")
    url = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[^:]*://([^/?#]*)", 1)).alias("_host")
    path = F.regexp_extract(url, r"^[^:]*://[^/?#]*([^?#]*)", 1).alias("_path")
    source = F.coalesce("html", F.lit(""))
    digest = F.unhex(F.md5(source)).alias("_page")
    read = pages.select(host, path, digest, source.alias("_html"))
    outlines = scratch.save(read.mapInArrow(_outlines, "host string, path string, page binary, story long, hashes array<long>, states array<tinyint>"), "outlines")
    # copies of a page are one, at the smallest of their paths
    first = F.min_by(F.struct("path", "story", "hashes", "states"), "path").alias("p")
    distinct = scratch.save(outlines.groupBy("host", "page").agg(first).select("host", "page", "p.*"), "pages")
    scratch.drop("outlines")
    beside = scratch.save(_neighbours(distinct, scratch), "neighbours")
    pairs = distinct.join(beside, ["host", "story"]).select("host", "page", "path", "hashes", "states", "before", "after")
    flags = scratch.save(pairs.mapInArrow(_flags, "host string, page binary, keep array<boolean>"), "flags")
    for name in ("pages", "ranges", "neighbours"):
        scratch.drop(name)
    # a column of pages may have any name; those that clash with the join's are renamed
    held, _ = shielded(pages.select(*others), "text", "_lines", "_host", "_page", "_html", "host", "page", "keep")
    names = dict(zip(others, held.columns, strict=True))
    rows = pages.select(source.alias("_html"), host, digest, *[F.col(c).alias(names[c]) for c in others])
    schema = StructType([*StructType.fromDDL("_lines array<string>, _host string, _page binary").fields, *held.schema.fields])
    parsed = rows.mapInArrow(_parsed, schema)
    joined = parsed.join(flags.select(F.col("host").alias("_host"), F.col("page").alias("_page"), "keep"), ["_host", "_page"])
    text = F.array_join(F.filter("_lines", lambda x, i: F.get("keep", i)), "\n").alias("text")
    back = {new: old for old, new in names.items() if old.lower() != "text"}
    return joined.select(text, *held.columns).withColumnsRenamed(back)


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: its main text and the text's length."""
    out = extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
