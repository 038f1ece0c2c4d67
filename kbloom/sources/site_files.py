"""Robots files, sitemaps and fetch results of already fetched bytes.

Nothing here opens a connection: rows hold what a fetcher has brought.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbloom.functions import urls

AGENT = "kbloom"
LEAST_INTERVAL_MS, MOST_INTERVAL_MS = 1000, 10_000
MOST_BYTES = 2 << 20
MOST_FILES, MOST_URLS, ENOUGH_URLS = 5, 500, 20
NOT_PAGES = "image|video|category|tag|author"


def _robots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from urllib.robotparser import RobotFileParser

    for batch in batches:
        rows = []
        for site, status, text, url in zip(batch.site, batch.status, batch.text, batch.url, strict=True):
            rules = RobotFileParser()
            # a missing or failing robots file allows everything
            rules.parse((text or "").splitlines() if status == 200 else [])
            delay = rules.crawl_delay(AGENT) if status == 200 else None
            allowed = status != 200 or not (text or "").strip() or rules.can_fetch(AGENT, url)
            rows.append((site, url, bool(allowed), float(delay) if delay is not None else None, "|".join(rules.site_maps() or [])))
        yield pd.DataFrame(rows, columns=["site", "url", "allowed", "delay", "sitemaps"])


def robots(files: DataFrame) -> DataFrame:
    """Whether each URL may be fetched, and the site's delay and sitemaps.

    ``files(site, status, text, url)``: a site's robots file beside a URL.
    """
    return files.select("site", "status", "text", "url").mapInPandas(_robots, "site long, url string, allowed boolean, delay double, sitemaps string")


def crawl_interval(delay: Column, floor_ms: int = LEAST_INTERVAL_MS) -> Column:
    """Milliseconds between two fetches of a site."""
    return F.least(F.greatest(F.lit(float(floor_ms)), F.coalesce(delay, F.lit(0.0)) * 1000), F.lit(float(MOST_INTERVAL_MS)))


def _sitemaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for source, xml in zip(batch.source, batch.xml, strict=True):
            xml = re.sub(r"<!--.*?-->", "", xml or "", flags=re.S)
            index = "<sitemapindex" in xml
            tag = "sitemap" if index else "url"
            for pos, m in enumerate(re.finditer(rf"<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", xml, re.S)):
                loc = re.search(r"<loc>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</loc>", m[1], re.S)
                when = re.search(r"<lastmod>\s*(.*?)\s*</lastmod>", m[1], re.S)
                if loc and loc[1]:
                    rows.append((source, pos, index, html.unescape(loc[1]), when[1] if when and when[1] else None))
        yield pd.DataFrame(rows, columns=["source", "pos", "is_index", "loc", "modified"])


def sitemap_entries(files: DataFrame) -> DataFrame:
    """The entries of ``files(source, xml)``: pages, or further sitemaps."""
    raw = files.select("source", "xml").mapInPandas(_sitemaps, "source string, pos int, is_index boolean, loc string, modified string")
    return raw.withColumn("url", urls.normalize_url(F.col("loc"))).where("url is not null").drop("loc")


def discover(origins: DataFrame, files: DataFrame, cut) -> DataFrame:
    """Pages of each site's sitemaps, breadth first through indexes.

    ``origins(site, origin, source)`` are the sitemaps to begin with and
    ``files(source, xml)`` what was fetched.  At most five files of a site are
    read and 500 pages kept, the last entry of a page counts; indexes of images,
    videos, categories, tags and authors are passed over.  Depth is bounded by
    the number of files, so this is a short loop of joins over entries that are
    parsed once: ``cut(df, name)`` writes a table and reads it back.
    """
    from pyspark.sql import Window

    entries = cut(sitemap_entries(files), "entries")
    level = origins.select("site", "origin", "source", F.lit(0).alias("depth"), F.array().cast("array<int>").alias("at"))
    every = level
    for depth in range(1, MOST_FILES):
        deeper = level.join(entries.where("is_index"), "source").where(~F.lower("url").rlike(NOT_PAGES))
        level = cut(deeper.select("site", "origin", F.col("url").alias("source"), F.lit(depth).alias("depth"), F.concat("at", F.array("pos")).alias("at")), f"level-{depth}")
        if level.isEmpty():
            break
        every = every.unionByName(level)
    first = every.groupBy("site", "origin", "source").agg(F.min(F.struct("depth", "at")).alias("o")).join(files.select("source").distinct(), "source", "left_semi")
    read = first.withColumn("k", F.row_number().over(Window.partitionBy("site").orderBy("o"))).where(F.col("k") <= MOST_FILES)
    pages = read.join(entries.where("not is_index"), "source").where(urls.same_site(F.col("url"), F.col("origin")) & urls.html_like(F.col("url")))
    # files are read until more than twenty pages are known
    known = pages.groupBy("site", "k").agg(F.count_distinct("url").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("site").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = known.withColumn("before", before).where(F.col("before") <= ENOUGH_URLS).select("site", "k")
    each = pages.join(wanted, ["site", "k"]).groupBy("site", "url").agg(F.min(F.struct("k", "pos")).alias("first"), F.max_by("modified", F.struct("k", "pos")).alias("modified"))
    return each.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy("first"))).where(F.col("place") <= MOST_URLS).select("site", "url", "modified", "place")


CHALLENGE = r"(?i)cf-browser-verification|challenge-platform|just a moment|attention required|captcha"


def fetch_outcome(url: Column, landed: Column, status: Column, kind: Column, n_bytes: Column, body: Column) -> Column:
    """struct(error, retryable) of a fetched page; error is null for a good one."""
    made = lambda error, retry=False: F.struct(F.lit(error).cast("string").alias("error"), (retry if isinstance(retry, Column) else F.lit(retry)).alias("retryable"))
    challenged = status.isin(403, 429, 503) & F.substring(body, 1, 4000).rlike(CHALLENGE)
    return (
        F.when(urls.blocked_host(urls.host_of(url)), made("blocked-address"))
        .when(status.isNull(), made("network", True))
        .when(~urls.same_site(url, landed), made("offsite-redirect"))
        .when(n_bytes > MOST_BYTES, made("too-large"))
        .when(F.coalesce(challenged, F.lit(False)), made("bot-challenge"))
        .when((status < 200) | (status >= 300), made("http-error", status >= 500))
        .when((F.coalesce(kind, F.lit("")) != "") & ~F.lower(kind).rlike("text/html|application/xhtml"), made("non-html"))
        .otherwise(made(None))
    )


#: Warnings by the kind of error; every other kind is a failed fetch.
WARNINGS = {"non-html": "non-html", "robots-disallow": "robots-disallow", "offsite-redirect": "redirect-offsite", "bot-challenge": "bot-challenge"}


def warning_code(error: Column) -> Column:
    out = F.when(error.isNull(), F.lit(None))
    for kind, code in WARNINGS.items():
        out = out.when(error == kind, code)
    return out.otherwise("fetch-failed")


def prompt_text(markdown: Column) -> Column:
    """The block quote under the heading ``## System prompt`` of a file."""
    section = F.regexp_extract(markdown, r"(?s)(?:^|\n)## System prompt[^\n]*\n(.*?)(?:\n## |$)", 1)
    lines = F.filter(F.split(section, "\n"), lambda x: x.startswith(">"))
    return F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, "^> ?", "")), "\n")
